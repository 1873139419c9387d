"""Keyed lookups with the checks that make them safe: ids, positions, hashes and timing rules.

An expectation that fails is a row of a violations table, or an error where a result must not be used; it is never dropped in silence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.functions.scalars import number


def aligned(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of both by position, one to one; positions of one side only, and keys that differ, are an error.

    Columns of the right that the left has too are left out, but for the key, which must agree.
    """
    own = right.select(position, F.col(key).alias("_key"), *[c for c in right.columns if c not in left.columns])
    both = left.withColumn("_l", F.lit(True)).join(own.withColumn("_r", F.lit(True)), position, "full_outer")
    fine = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col(key).eqNullSafe(F.col("_key"))
    checked = F.when(fine, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not aligned at "), F.col(position).cast("string"))).cast(left.schema[key].dataType))
    return both.withColumn(key, checked).drop("_key", "_l", "_r")


def alignment_errors(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """(position, left key, right key) wherever `aligned` would fail."""
    a = left.select(position, F.col(key).alias(f"left_{key}"), F.lit(True).alias("_l"))
    b = right.select(position, F.col(key).alias(f"right_{key}"), F.lit(True).alias("_r"))
    both = a.join(b, position, "full_outer")
    fine = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col(f"left_{key}").eqNullSafe(F.col(f"right_{key}"))
    return both.where(~fine).select(position, f"left_{key}", f"right_{key}")


def proxy_numbers(origins: DataFrame, proxy: DataFrame, key: str, fields: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """`origins` with the proxy's fields as doubles, blanks null, by `key`.

    An origin without a row, a row whose timing-rule column isn't what `rules` says, and a key of two rows are errors. `proxy` is all text.
    """
    named = [F.when(F.trim(F.col(f)) == "", F.lit(None).cast("double")).otherwise(F.trim(F.col(f)).cast("double")).alias(f) for f in fields]
    timed = F.lit(True)
    for column, rule in rules.items():
        timed = timed & F.col(column).eqNullSafe(F.lit(rule))
    one = proxy.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.min(timed).alias("_timed"), *[F.first(f).alias(f) for f in fields])
    found = origins.join(one, F.col(key) == F.col("_key"), "left")
    problem = F.when(F.col("_n").isNull(), F.lit("no proxy row for ")).when(F.col("_n") > 1, F.lit("two proxy rows for ")).when(~F.col("_timed"), F.lit("another timing rule for "))
    checked = F.when(problem.isNull(), F.col(key)).otherwise(F.raise_error(F.concat(problem, F.col(key))))
    return found.select(*[checked.alias(key) if c == key else F.col(c) for c in origins.columns], *named)


def proxy_violations(origins: DataFrame, proxy: DataFrame, key: str, fields: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """(rule, violations): what `proxy_numbers` would fail on, and fields that hold text which is no number."""
    repeated = proxy.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_key"))
    lost = origins.select(key).join(proxy.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("missing_key"))
    timed = [F.count_if(~F.col(c).eqNullSafe(F.lit(r))).alias(c) for c, r in rules.items()]
    broken = F.lit(False)
    for f in fields:
        broken = broken | ((F.trim(F.col(f)) != "") & number(F.col(f)).isNull())
    told = proxy.agg(*timed, F.count_if(broken).alias("not_a_number"))
    names = ["repeated_key", "missing_key", *rules, "not_a_number"]
    parts = [(repeated, names[:1]), (lost, names[1:2]), (told, names[2:])]
    rows = [d.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in ns]))) for d, ns in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def checked_records(requests: DataFrame, records: DataFrame, sources: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """(key, problem) for every request: null, or why its record can't be used.

    no_record, no_source, or differs:<column> for the first of `compared` in which request, record and source don't agree (index, text hash, ...).
    A column that one of the three lacks isn't compared there.
    """
    out = requests.select(key, *[F.col(c).alias(f"q_{c}") for c in compared if c in requests.columns])
    for side, df in (("r", records), ("s", sources)):
        out = out.join(df.select(key, F.lit(True).alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in compared if c in df.columns]), key, "left")
    problem = F.when(F.col("_r").isNull(), "no_record").when(F.col("_s").isNull(), "no_source")
    for c in compared:
        held = [F.col(f"{side}_{c}") for side in ("q", "r", "s") if f"{side}_{c}" in out.columns]
        for other in held[1:]:
            problem = problem.when(~held[0].eqNullSafe(other), f"differs:{c}")
    return out.select(key, problem.alias("problem"))


def prepared(features: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, problem) for the prepared records of two tables: null, or no_target, no_feature, repeated, text_differs, label_differs or not_after_origin.

    `features` has text, text_sha256 and origin; `targets` has action, direction and published.
    """
    a = features.groupBy(key).agg(F.count("*").alias("nf"), F.first("text").alias("text"), F.first("text_sha256").alias("sha"), F.first("origin").alias("origin"))
    b = targets.groupBy(key).agg(F.count("*").alias("nt"), F.first("action").alias("action"), F.first("direction").alias("direction"), F.first("published").alias("published"))
    both = a.join(b, key, "full_outer")
    sign = F.when(F.col("action") < 0, "cut").when(F.col("action") > 0, "hike").when(F.col("action") == 0, "hold")
    problem = (
        F.when(F.col("nt").isNull(), "no_target").when(F.col("nf").isNull(), "no_feature").when((F.col("nf") > 1) | (F.col("nt") > 1), "repeated")
        .when(~F.sha2(F.col("text").cast("binary"), 256).eqNullSafe(F.col("sha")), "text_differs")
        .when(~sign.eqNullSafe(F.col("direction")), "label_differs").when(~F.coalesce(F.col("published") > F.col("origin"), F.lit(False)), "not_after_origin")
    )
    return both.select(key, problem.alias("problem"))


def aligned_labels(labels: DataFrame, documents: DataFrame, key: str, columns: Sequence[str], compared: Sequence[str], uncertain: str = "U") -> DataFrame:
    """Documents in full, each with its labels as -1, 0, 1 or null, and aligned: whether a row of labels is there whose `compared` columns agree.

    The uncertain mark and blanks are null; any other text is null too, and leaves aligned false.
    """
    told = labels.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in (*columns, *compared)])
    both = documents.join(told, key, "left")
    fine = F.coalesce(F.col("_there"), F.lit(False))
    for c in compared:
        fine = fine & F.col(f"_{c}").eqNullSafe(F.col(c))
    made = []
    for c in columns:
        clean = F.trim(F.col(f"_{c}"))
        code = F.when(clean.isin("-1", "0", "1"), clean.cast("int"))
        fine = fine & (clean.isNull() | clean.isin("", uncertain, "-1", "0", "1"))
        made.append(code.alias(c))
    return both.select(*documents.columns, *made, fine.alias("aligned"))


def separation_errors(blind: DataFrame, private: DataFrame, index: str, shared: Sequence[str], secret: Sequence[str]) -> DataFrame:
    """(rule, violations) of a blind table and its private counterpart: same index on both sides, `shared` columns equal, none of the secret ones in the blind table."""
    both = blind.select(index, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in shared]).join(
        private.select(index, F.lit(True).alias("_p"), *[F.col(c).alias(f"p_{c}") for c in shared]), index, "full_outer"
    )
    paired = F.col("_b").isNotNull() & F.col("_p").isNotNull()
    cells = {"only_blind": F.col("_p").isNull(), "only_private": F.col("_b").isNull()} | {f"{c}_differs": paired & ~F.col(f"b_{c}").eqNullSafe(F.col(f"p_{c}")) for c in shared}
    told = len(set(secret) & set(blind.columns))
    counts = both.agg(*[F.count_if(v).alias(n) for n, v in cells.items()])
    rows = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in cells] + [F.struct(F.lit("secret_column").alias("rule"), F.lit(told).cast("long").alias("violations"))]
    return counts.select(F.inline(F.array(*rows)))


def run_errors(records: DataFrame, expected: DataFrame, identity: Sequence[str], run: str, target: str, document: str) -> DataFrame:
    """(rule, violations) of a run: identities missing, unexpected and repeated, runs beyond one, and documents whose target hash isn't one and the same."""
    got = records.groupBy(*identity).agg(F.count("*").alias("n"))
    want = expected.select(*identity).distinct()
    counts = {
        "missing": want.join(got, list(identity), "left_anti").agg(F.count("*").alias("v")),
        "unexpected": got.join(want, list(identity), "left_anti").agg(F.count("*").alias("v")),
        "repeated": got.where("n > 1").agg(F.count("*").alias("v")),
        "runs_beyond_one": records.agg(F.greatest(F.count_distinct(run) - 1, F.lit(0)).cast("long").alias("v")),
        "target_changes": records.groupBy(document).agg(F.count_distinct(target).alias("k")).where("k > 1").agg(F.count("*").alias("v")),
    }
    out = None
    for name, df in counts.items():
        row = df.select(F.lit(name).alias("rule"), F.col("v").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def manifest_errors(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem): missing, unexpected or differs, for members (path, sha256) against a manifest (path, sha256) of the same folder or archive."""
    a, b = members.select("path", F.col("sha256").alias("_got")), manifest.select("path", F.col("sha256").alias("_want"))
    both = a.join(b, "path", "full_outer")
    problem = F.when(F.col("_got").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_got") != F.col("_want"), "differs")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def stored_vectors(cache: DataFrame, origins: DataFrame, key: str, position: str, dimension: int) -> DataFrame:
    """(position, key, problem) of every origin: null, or no_vector, out_of_order, hash_differs, wrong_length or not_finite.

    `cache` is (position, key, text_sha256, vector) in the order it was written, `origins` (position, key, text_sha256).
    """
    held = cache.select(F.col(position).alias("_p"), F.col(key).alias("_k"), F.col("text_sha256").alias("_sha"), "vector")
    both = origins.join(held, F.col(key) == F.col("_k"), "left")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = (
        F.when(F.col("_k").isNull(), "no_vector").when(F.col("_p") != F.col(position), "out_of_order").when(~F.col("_sha").eqNullSafe(F.col("text_sha256")), "hash_differs")
        .when(F.size("vector") != dimension, "wrong_length").when(bad, "not_finite")
    )
    return both.select(position, key, problem.alias("problem"))


def vector_digest(vectors: DataFrame, order: Sequence[str], vector: str = "vector") -> DataFrame:
    """(n, sha256): a digest of a matrix that is the same however its rows are dealt, from a digest of each row.

    Rows are hashed apart, and their digests are hashed by buckets of the order's hash and then together, so no task holds more than digests.
    """
    row = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in order], F.array_join(F.transform(vector, lambda x: F.format_string("%.9e", x.cast("double"))), ",")).cast("binary"), 256)
    rows = vectors.select(row.alias("d")).withColumn("bucket", F.substring("d", 1, 4))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ",").cast("binary"), 256).alias("d"))
    return buckets.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda b: b["d"]), ",").cast("binary"), 256).alias("sha256"))


def json_list(raw: Column, schema: str) -> Column:
    """The objects of a JSON list, to be exploded with `inline`."""
    return F.from_json(raw, f"array<struct<{schema}>>")
