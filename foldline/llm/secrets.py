"""Secret scans through an incremental ledger of blobs, in built-in functions only.

A text is a blob, named by its SHA-256. A rule version is a name and its rules. The ledger keeps, in Parquet, which (blob, rule
version) pairs were scanned and what was found in them. A scan hashes the versions it is given, and looks up which pairs the
ledger lacks before any text moves; where there are none it ends there. It keeps one text of each blob that is left, and
searches that; findings are joined back to every path by the blob's name. Copies are merged before the shuffle by partial
aggregation, and a blob that many paths share is only a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kind, pattern up to the measured part, the measured part, least characters of the measured part.
#: Fixed values; their order breaks ties of spans that start together.
RULES = (
    ("assign", r"(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)", r"[A-Za-z0-9+/_.=-]+", 6),
    ("access", r"", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"", r"[0-9a-f]{24,}", 24),
)
Rule = tuple[str, str, str, int]
RULE_VERSION = "base-1"
#: Unseen blobs up to which their names are broadcast, so that no other text moves: 64 bytes each.
FEW = 20_000
#: Characters that mark spans while a text is cut; in the text itself they are replaced by one of the same length.
EDGE, MEASURED, STAND_IN = "\ue000", "\ue001", "\ue002"
FINDING = "array<struct<kind:string,start:long,end:long>>"


def blob_of(text: Column) -> Column:
    """The content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _cuts(kind: str, head: str, body: str, least: int) -> Column:
    """The text's pieces for one rule: outside, match, outside, ...; each a struct of its length and whether it is kept."""
    marked = F.regexp_replace("body", f"({head})({body})", f"{EDGE}$1{MEASURED}$2{EDGE}")
    pieces = F.split(marked, EDGE, -1)
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            F.lit(kind).alias("kind"),
            (F.char_length(p) - (i % 2)).cast("long").alias("len"),
            ((i % 2 == 1) & (F.char_length(F.substring_index(p, MEASURED, -1)) >= least)).alias("hit"),
        ),
    )


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, findings) for (blob, text) with unique blobs: the spans in code points, end exclusive.

    Within a rule, matches are the leftmost that don't overlap; those whose measured part is too short are
    dropped after matching. findings is sorted by start, then by the order of the rules. Texts without any have
    an empty array.

    The lengths of a text's pieces are summed in a window over the blob, which costs in proportion to the
    pieces, however many one text has; a text without a match is one row there.
    """
    mapped = blobs.select("blob", F.translate(F.coalesce("text", F.lit("")), EDGE + MEASURED, STAND_IN * 2).alias("body"))
    cut = mapped.select("blob", *[_cuts(*rule).alias(rule[0]) for rule in rules])
    arrays = F.array(*[F.when(F.size(r[0]) > 1, F.col(r[0])) for r in rules])
    pieces = (
        cut.select("blob", F.explode_outer(F.filter(arrays, lambda a: a.isNotNull())).alias("pieces"))
        .select("blob", F.posexplode_outer("pieces").alias("pos", "piece"))
        .select("blob", "pos", "piece.*")
    )
    order = Window.partitionBy("blob", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = pieces.withColumn("end", F.sum("len").over(order))
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r[0]), F.lit(i))])
    start = (F.col("end") - F.col("len")).alias("start")
    hit = F.when(F.col("hit"), F.struct(start, rank[F.col("kind")].alias("rank"), "kind", "end"))
    return spans.groupBy("blob").agg(
        F.transform(
            F.sort_array(F.collect_list(hit)),
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
        ).alias("findings")
    )


class BlobLedger:
    """(blob, rule_version, findings) of everything scanned, as a Parquet table at `path`.

    `path` is any folder all executors share. `rules` are (kind, pattern up to the measured part, the measured part, its least
    characters), kinds differing; a version is its name and a digest of its rules, so other rules under a known name are another version.
    A scan appends in one committed write, so one that fails leaves the ledger as it was. Scanning the same versions again searches
    no text, moves none, and adds no row.
    """

    def __init__(self, spark: SparkSession, path: str, rule_version: str = RULE_VERSION, rules: Sequence[Rule] = RULES):
        if len({r[0] for r in rules}) < len(rules) or not rules:
            raise ValueError("rules need kinds that differ, and one at least")
        self.spark, self.path, self.rules = spark, path, tuple(rules)
        self.rule_version = f"{rule_version}:{hashlib.sha256(repr(self.rules).encode()).hexdigest()[:12]}"

    def _begun(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def entries(self) -> DataFrame:
        """(blob, findings), one row a blob, under this rule version."""
        schema = f"blob string, rule_version string, findings {FINDING}"
        if not self._begun():
            return self.spark.createDataFrame([], schema).select("blob", "findings")
        held = self.spark.read.schema(schema).parquet(self.path)
        return held.where(F.col("rule_version") == self.rule_version).select("blob", "findings")

    def scan(self, versions: DataFrame, text_col: str = "text") -> None:
        """Scan the blobs among `versions` that the ledger lacks under this rule version, and record them.

        An empty table adds nothing; null texts are the empty blob.
        """
        rows = versions.select(F.col(text_col).cast("string").alias("text")).select(blob_of(F.col("text")).alias("blob"), "text")
        if self._begun():
            lacking = rows.select("blob").distinct().join(self.entries().select("blob"), "blob", "left_anti")
            few = lacking.limit(FEW + 1).count()
            if not few:
                return
            if few <= FEW:
                rows = rows.join(F.broadcast(lacking), "blob", "left_semi")
        unseen = rows.dropDuplicates(["blob"]).join(self.entries(), "blob", "left_anti")
        scanned = scan_blobs(unseen, self.rules).select("blob", F.lit(self.rule_version).alias("rule_version"), "findings")
        scanned.write.mode("append").parquet(self.path)

    def findings_of(self, versions: DataFrame, text_col: str = "text") -> DataFrame:
        """`versions` with one more column `secret_spans`: findings of its text, empty if none; null texts have none.

        Columns may have any names but that one (ValueError); rows, repeats included, stay.
        """
        if "secret_spans" in [c.lower() for c in versions.columns]:
            raise ValueError("column secret_spans is made here")
        # Plain names inside, whatever the columns are called.
        names = [f"c{i}" for i in range(len(versions.columns))]
        keyed = versions.toDF(*names).withColumn("blob", blob_of(F.col(names[versions.columns.index(text_col)]).cast("string")))
        found = self.entries().where(F.size("findings") > 0)
        joined = keyed.join(found, "blob", "left").select(*names, F.coalesce("findings", F.array().cast(FINDING)).alias("secret_spans"))
        return joined.toDF(*versions.columns, "secret_spans")


def spans_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by `mark`; overlapping spans are one. No spans: the text itself."""
    empty = F.struct(F.array().cast("array<struct<start:long,end:long>>").alias("done"), F.lit(0).cast("long").alias("end"))
    merged = F.aggregate(
        spans,
        empty,
        lambda acc, s: F.struct(
            F.when(
                (F.size(acc["done"]) > 0) & (s["start"] < acc["end"]),
                F.concat(
                    F.slice(acc["done"], 1, F.size(acc["done"]) - 1),
                    F.array(F.struct(F.element_at(acc["done"], -1)["start"].alias("start"), F.greatest(acc["end"], s["end"]).alias("end"))),
                ),
            )
            .otherwise(F.concat(acc["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
            .alias("done"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        ),
    )["done"]

    def rebuilt(spans: Column) -> Column:
        kept = F.transform(
            spans,
            lambda s, i: F.concat(
                F.substring(
                    text,
                    F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]).cast("int") + 1,
                    (s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])).cast("int"),
                ),
                F.lit(mark),
            ),
        )
        tail = F.substring(text, F.element_at(spans, -1)["end"].cast("int") + 1, F.char_length(text))
        return F.concat(F.array_join(kept, ""), tail)

    # The merged array is bound once, by a transform over an array that holds it alone.
    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(merged), rebuilt), 1)).otherwise(text)
