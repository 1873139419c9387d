"""Results that several plans read, written once to the session's checkpoint folder; and small ones, sent to all executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table of a few narrow columns that `sent` hands to every executor, at most.
FEW = 100_000


def settled(df: DataFrame) -> DataFrame:
    """`df`, computed once and read from the shared folder that spark.checkpoint.dir names ever after.

    Where none is named, a local folder will do for a local master only; elsewhere that is an error (RuntimeError).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="foldline-settled-"))
    return df.checkpoint(eager=True)


def sent(df: DataFrame) -> DataFrame:
    """`df` as a join's side that is broadcast where it has `FEW` rows at most, which are counted; as it is where it has more."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
