"""Token totals kept up to date by signed deltas.

A batch of changes says which documents were inserted, deleted or recounted. Committing it subtracts what
the ledger holds of those documents and adds what the batch says, as one small table of signed sums by
source, language and tokenizer version; totals are the sums of those tables. A batch becomes visible by
its marker, which is written last: a batch that fails half-way leaves nothing to be seen, and one that is committed
again changes nothing.

The ledger is dealt into buckets by a hash of its key, and a commit reads the buckets that its changes touch. `compact` merges what
was committed so far into one snapshot, so that reading doesn't grow with the number of batches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("doc_id", "tokenizer_version")
GROUP = ("source", "lang", "tokenizer_version")
CHANGE = "op string, doc_id long, tokenizer_version string, source string, lang string, n_tokens long"
LEDGER = "batch long, doc_id long, tokenizer_version string, source string, lang string, n_tokens long, bucket int"
DELTA = "source string, lang string, tokenizer_version string, documents long, tokens long"
#: Patterns of the built-in token counts, by tokenizer version: runs between white space, and runs of ASCII letters or digits.
VERSIONS = {"space-1": r"[^\x20\x09-\x0D]+", "alnum-2": r"[A-Za-z0-9]+"}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a text under a built-in version; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


class TokenRollup:
    """Totals and the ledger behind them, under `path`, a folder that all executors share.

    Batches have consecutive numbers, and one driver at a time can claim the next: another that tries meanwhile gets a RuntimeError and may
    try again. A driver that dies with its claim leaves it; `recover` takes it back, when no other driver is at work.

    `buckets` is fixed when a ledger is begun, and is to grow with it: a task of a commit holds the changes of a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, files = self._at(folder)
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(n for n in names if not n.startswith((".", "_")))

    def batches(self) -> list[str]:
        """Committed batches in their order."""
        return [n.partition(".")[2] for n in self._names("commits")]

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The newest snapshot and what was committed after it."""
        snapshot = max(self._names("snapshots"), default="")
        later = [n for n in self._names("commits") if n.partition(".")[0] >= snapshot]
        paths = [f"{self.path}/{kind}/{n}" for n in ([f"snapshot-{snapshot}"] if snapshot else []) + later]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Files of one folder a batch: the bucket is read from its subfolder's name.
        rows = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """The last word on each document and tokenizer version, of these buckets only if given: a count, or null for a deleted one."""
        rows = self._read("ledger", LEDGER)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        last = F.max_by(F.struct("source", "lang", "n_tokens"), "batch").alias("last")
        return rows.groupBy(*KEY).agg(last).select(*KEY, "last.*")

    def _write_ledger(self, rows: DataFrame, name: str) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")
        path = f"{self.path}/ledger/{name}"
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(LEDGER).parquet(path)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch of (op, doc_id, tokenizer_version, source, lang, n_tokens, and seq if there is one); False if it was committed before.

        op is insert, revise or delete. Inserting what is there, or revising what isn't, sets the count all the same;
        deleting what isn't there does nothing; other or null ops are an error. Of several changes of one document
        and version the last by seq, a long, counts, so what was inserted and then deleted is gone; a null or missing seq is 0, and of
        equal ones the highest by (op, source, lang, n_tokens) counts, so repeats are harmless. Null keys and groups are values
        like any other; null counts are 0. An empty batch is committed and changes nothing.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
            raise ValueError(f"a batch id is letters, digits, _ and -: {batch_id!r}")
        done = self._names("commits")
        if batch_id in [n.partition(".")[2] for n in done]:
            return False
        number = int(done[-1].partition(".")[0]) + 1 if done else 0
        claim, files = self._at(f"claims/{number:09d}")
        files.mkdirs(claim.getParent())
        if not files.createNewFile(claim):
            raise RuntimeError(f"another driver has claimed batch number {number}")
        try:
            self._apply(f"{number:09d}.{batch_id}", number, changes)
            marker, _ = self._at(f"commits/{number:09d}.{batch_id}")
            files.mkdirs(marker.getParent())
            files.createNewFile(marker)
        except BaseException:
            files.delete(claim, False)
            raise
        return True

    def _apply(self, name: str, number: int, changes: DataFrame) -> None:
        seq = F.coalesce(F.col("seq").cast("long"), F.lit(0)) if "seq" in changes.columns else F.lit(0)
        picked = changes.select(
            F.when(F.col("op").isin("insert", "revise", "delete"), F.col("op")).otherwise(F.raise_error(F.lit("unknown op"))).alias("op"),
            F.col("doc_id").cast("long").alias("doc_id"), F.col("tokenizer_version").cast("string").alias("tokenizer_version"),
            F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), seq.cast("long").alias("seq"),
        )
        one = picked.groupBy(*KEY).agg(F.max(F.struct("seq", "op", "source", "lang", "n_tokens")).alias("c")).select(*KEY, "c.*")
        gone = F.col("op") == "delete"
        said = one.select(F.lit(number).cast("long").alias("batch"), *KEY, "source", "lang", F.when(~gone, F.col("n_tokens")).alias("n_tokens"))
        said = self._write_ledger(said, name)
        new = said.where("n_tokens IS NOT NULL").select(*GROUP, F.lit(1).alias("sign"), "n_tokens")
        signed = new
        if number:
            touched = said.select(*[F.col(k).alias(f"t_{k}") for k in KEY])
            held = self.ledger([r["bucket"] for r in said.select("bucket").distinct().collect()]).where("n_tokens IS NOT NULL")
            same = held["doc_id"].eqNullSafe(touched["t_doc_id"]) & held["tokenizer_version"].eqNullSafe(touched["t_tokenizer_version"])
            signed = new.union(held.join(touched, same, "left_semi").select(*GROUP, F.lit(-1), "n_tokens"))
        deltas = signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")

    def recover(self) -> bool:
        """Take back the claim of a driver that died; whether there was one. Call it only when no other driver commits."""
        free = len(self._names("commits"))
        claim, files = self._at(f"claims/{free:09d}")
        return bool(files.exists(claim) and files.delete(claim, False))

    def compact(self) -> None:
        """Merge all that was committed into one snapshot of the ledger and the totals, which reading then begins with.

        Deleted documents are left out of it, and so are sums of no document. It holds the next batch number meanwhile.
        """
        number = len(self._names("commits"))
        claim, files = self._at(f"claims/{number:09d}")
        files.mkdirs(claim.getParent())
        if not files.createNewFile(claim):
            raise RuntimeError(f"another driver has claimed batch number {number}")
        try:
            name = f"{number:09d}"
            kept = self.ledger().where("n_tokens IS NOT NULL")
            self._write_ledger(kept.select(F.lit(number - 1).cast("long").alias("batch"), *KEY, "source", "lang", "n_tokens"), f"snapshot-{name}")
            self.totals().write.mode("overwrite").parquet(f"{self.path}/deltas/snapshot-{name}")
            marker, _ = self._at(f"snapshots/{name}")
            files.mkdirs(marker.getParent())
            files.createNewFile(marker)
        finally:
            files.delete(claim, False)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, documents, tokens) of all groups that have a document."""
        sums = self._read("deltas", DELTA).groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0")
