"""Weighted rendezvous hashing of stable record keys over shards, in built-in functions only.

Every shard scores a key by -weight / ln(u), u in (0, 1) hashed from the key and the shard's name;
the highest score takes the record. A new shard only adds a score, so records move to it and
nowhere else, in proportion to its weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a digest that make u: 13 digits are 52 bits, exact in a double.
DIGITS = 13
#: Hex digits of the key's digest that make the numbering buckets of a shard: 4096 of them.
BUCKET_DIGITS = 3
#: Different rows of a key from which on it has buckets of its own, and equal rows that are written out at once.
HOT_KEY, LONG_RUN = 100_000, 1 << 20


def unit(key: Column) -> Column:
    """A double in (0, 1) from the key's MD5."""
    return (F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard that takes `key` (a string); ties, which take equal digests, go to the highest number."""
    scores = [
        F.struct((F.lit(-float(w)) / F.ln(unit(F.concat(key, F.lit(f"#{s}"))))).alias("score"), F.lit(s).alias("shard"))
        for s, w in sorted(weights.items())
    ]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign_shards(
    df: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None, key_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of `df`: (key, size, text_crc32, law, shard, slot, grown_shard).

    `weights` maps each shard to its weight, a finite number over 0, `grown` likewise after shards are added (null: no such column
    value); no shards, or another weight, are an error (ValueError). size is the UTF-8 bytes of the text plus 1, null texts having none (and CRC 0). slot numbers a
    shard's rows from 0 without gaps, by key digest, key, CRC and size; equal rows in any order. The key
    alone decides the shard: null keys hash as one key of their own, repeated keys share a shard. An empty
    table gives no rows.

    Equal rows are counted first and numbered as one run. Runs are numbered within buckets of a shard (16**BUCKET_DIGITS of them, by leading
    digits of the key's digest), then a bucket's offset is added. A key of over HOT_KEY different rows has buckets of its own, by leading bits
    of the CRC, and a run of over LONG_RUN equal rows is written out in parts that are dealt anew: no task holds a shard, a key or a run.
    """
    for given in (weights, *([grown] if grown is not None else [])):
        if not given or not all(math.isfinite(w) and w > 0 for w in given.values()):
            raise ValueError(f"weights must be finite and over 0, of one shard at least: {given}")
    key = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    rows = df.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("body")).select(
        "key",
        (F.coalesce(F.octet_length("body"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("body").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.md5(key).alias("digest"),
    )
    groups = rows.groupBy("shard", "grown_shard", "digest", "key", "size", "text_crc32").agg(F.count("*").alias("n"))
    groups = groups.withColumn("prefix", F.substring("digest", 1, BUCKET_DIGITS))
    many = groups.groupBy("shard", "prefix", "digest").agg(F.count("*").alias("m")).where(F.col("m") > HOT_KEY)
    hot = many.groupBy("shard", "prefix").agg(F.collect_list("digest").alias("hot"))
    # Buckets in the rows' order: those before, of, between and behind the hot keys of a prefix.
    below = F.size(F.filter("hot", lambda d: d < F.col("digest")))
    own = F.coalesce(F.array_contains("hot", F.col("digest")), F.lit(False))
    placed = groups.join(hot, ["shard", "prefix"], "left").withColumns(
        {"part": F.when(F.col("hot").isNull(), F.lit(0)).otherwise(2 * below + own.cast("int")), "bits": F.when(own, F.shiftright("text_crc32", 20)).otherwise(F.lit(0).cast("long"))}
    )
    bucket = ["shard", "prefix", "part", "bits"]
    inside = Window.partitionBy(*bucket).orderBy("digest", "key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("shard").orderBy("prefix", "part", "bits").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*bucket).agg(F.sum("n").alias("rows"))
    offsets = sums.select(*bucket, F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")).alias("offset"))
    runs = placed.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0).cast("long"))).join(offsets, bucket)
    runs = runs.select("key", "size", "text_crc32", "shard", "grown_shard", "n", (F.col("offset") + F.col("first")).alias("first"))
    out = ["key", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"), "grown_shard"]
    most = groups.agg(F.max("n")).first()[0] or 0
    if most <= LONG_RUN:
        return runs.select(*out)
    steps = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(LONG_RUN).cast("long"))
    parts = runs.where(F.col("n") > LONG_RUN).withColumn("step", F.explode(steps))
    parts = parts.withColumns({"first": F.col("first") + F.col("step"), "n": F.least(F.lit(LONG_RUN).cast("long"), F.col("n") - F.col("step"))})
    return runs.where(F.col("n") <= LONG_RUN).select(*out).unionByName(parts.repartition("shard", "key", "step").select(*out))
