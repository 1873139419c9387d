"""Integrity: expectations as DataFrames of violations, and strict checks of JSON answers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of evidence at most.
EVIDENCE = 240


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): keys that only the left or only the right has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left_only")).union(b.exceptAll(a).withColumn("side", F.lit("right_only")))


def expected_identities(spark_df: DataFrame, levels: dict[str, Sequence], keys: str) -> DataFrame:
    """Every combination of the constant `levels` with the keys of `spark_df`: what a complete run has."""
    out = spark_df.select(keys).distinct()
    for name, values in levels.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def mismatches(computed: DataFrame, stored: DataFrame, keys: Sequence[str], names: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, metric, computed, stored) where they differ by more than the tolerance, absolute or relative, or one is missing."""

    def long(df: DataFrame, as_: str) -> DataFrame:
        return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(as_)) for n in names])))

    both = long(computed, "computed").join(long(stored, "stored"), [*keys, "metric"], "full_outer")
    gap = F.abs(F.col("computed") - F.col("stored"))
    bound = F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs("computed"), F.abs("stored")))
    fine = (F.col("computed").isNull() & F.col("stored").isNull()) | F.coalesce(gap <= bound, F.lit(False))
    return both.where(~fine)


def probability_violations(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows whose probabilities aren't finite, in [0, 1] and of sum 1."""
    bad = F.lit(False)
    total = F.lit(0.0)
    for c in columns:
        x = F.col(c)
        bad = bad | x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
        total = total + x
    return df.where(bad | (F.abs(total - 1.0) > tolerance))


def answer_status(raw: Column, text: Column, ended: Column, axes: Sequence[str]) -> Column:
    """valid or invalid_output for a JSON answer {axis: {score, evidence}}.

    It must have ended, hold these axes and fields and no others, whole scores -1, 0 or 1 (1.0, true and "1" aren't), and evidence
    of up to EVIDENCE characters that stands literally in the text, and isn't blank where the score isn't 0. Of keys given
    twice the last counts.
    """
    axis = T.StructType([T.StructField("score", T.IntegerType()), T.StructField("evidence", T.StringType())])
    parsed = F.from_json(raw, T.StructType([T.StructField(a, axis) for a in axes]))
    fine = ended & parsed.isNotNull() & F.array_sort(F.array_distinct(F.json_object_keys(raw))).eqNullSafe(F.lit(sorted(axes)))
    for a in axes:
        part = F.get_json_object(raw, f"$.{a}")
        score, evidence = parsed[a]["score"], parsed[a]["evidence"]
        fine = fine & F.array_sort(F.array_distinct(F.json_object_keys(part))).eqNullSafe(F.lit(["evidence", "score"]))
        fine = fine & score.isin(-1, 0, 1) & evidence.isNotNull() & (F.char_length(evidence) <= EVIDENCE)
        # A string field also reads numbers and objects as text: the raw value must be quoted.
        fine = fine & F.get_json_object(raw, f"$.{a}.evidence").isNotNull() & part.rlike(r'"evidence"\s*:\s*"')
        fine = fine & ((score == 0) | (F.trim(evidence) != "")) & F.contains(text, evidence)
    return F.when(F.coalesce(fine, F.lit(False)), "valid").otherwise("invalid_output")


#: Pieces of JSON: white space, a string, and the whole numbers that an axis may have. Fixed values.
JSON_SPACE = r"[ \t\n\r]*+"
JSON_STRING = r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)"'
MEMBER = rf"{JSON_STRING}{JSON_SPACE}:{JSON_SPACE}(-?[01])(?![0-9.eE])"
ANSWER = rf"^\{{{JSON_SPACE}(?:{MEMBER}{JSON_SPACE}(?:,{JSON_SPACE}(?=\")|(?=\}})))*+(?<!,)\}}"
#: White space of texts: Unicode's, and the four separators below it. A fixed value.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def first_object(raw: Column, axes: Sequence[str]) -> Column:
    """struct(axes as ints, strict boolean) of the answer in a text, null if there is none.

    The answer is the JSON object that begins at the first brace, never a later one. It must name each axis once, whatever way its name is escaped,
    and nothing else, with a whole number of -1, 0 or 1 (true, 1.0 and "1" aren't). strict: only white space stands around it.
    """
    begin = F.instr(raw, "{")
    tail = F.when(begin > 0, F.substring(raw, begin, F.char_length(raw)))
    body = F.regexp_extract(tail, ANSWER, 0)
    names = F.transform(F.regexp_extract_all(body, F.lit(MEMBER), F.lit(1)), lambda n: F.get(F.from_json(F.concat(F.lit('["'), n, F.lit('"]')), "array<string>"), F.lit(0)))
    values = F.transform(F.regexp_extract_all(body, F.lit(MEMBER), F.lit(2)), lambda v: v.cast("int"))
    fine = (body != "") & F.array_sort(names).eqNullSafe(F.lit(sorted(axes)))
    around = F.concat(F.substring(raw, 1, begin - 1), F.substring(tail, F.char_length(body) + 1, F.char_length(tail)))
    found = [F.get(values, F.array_position(names, a).cast("int") - 1).alias(a) for a in axes]
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(*found, (F.regexp_replace(around, BLANK, "") == "").alias("strict")))


def parse_first_objects(df: DataFrame, column: str, axes: Sequence[str]) -> DataFrame:
    """`df` with one int column for each axis, and strict: all null where there is no valid first object. Other columns stay, in their order."""
    parsed = df.withColumn("_p", first_object(F.col(column), axes))
    return parsed.select(*df.columns, *[F.col("_p")[a].alias(a) for a in axes], F.col("_p")["strict"].alias("strict"))


def canonical(value: object) -> str:
    """JSON with sorted keys and an indent of 2, without NaN, ending in a line feed."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n"


def envelope_errors(df: DataFrame, column: str = "raw", task: str | None = None) -> DataFrame:
    """`df` with error: null for an envelope {task, identity, sha, data} whose sha is that of data as canonical JSON, and, if `task` names a column, whose task is that."""

    def one(text: str | None, expected: str | None) -> str | None:
        try:
            found = json.loads(text or "")
            given = hashlib.sha256(canonical(found["data"]).encode()).hexdigest()
            if found["sha"] != given:
                return "sha differs"
            return None if task is None or found["task"] == expected else "task differs"
        except (ValueError, KeyError, TypeError):
            return "not an envelope"

    @F.pandas_udf("string")
    def check(raw: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series([one(r, e) for r, e in zip(raw, expected, strict=True)], dtype=object)

    return df.withColumn("error", check(F.col(column), F.col(task) if task else F.lit(None).cast("string")))


def stored_hash_errors(df: DataFrame, text: str, stored: str, keys: Sequence[str]) -> DataFrame:
    """(keys, computed, stored) of rows whose stored SHA-256 isn't that of their text; a null on one side is a difference."""
    computed = F.sha2(F.col(text).cast("binary"), 256)
    return df.where(~computed.eqNullSafe(F.col(stored))).select(*keys, computed.alias("computed"), F.col(stored).alias("stored"))
