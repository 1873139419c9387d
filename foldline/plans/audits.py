"""Queries on sources, sinks, lookups and integrity checks, with the driver's tables in the part of the study's files.

Files that a query reads are written first, from whole tables of fixed size (regions and nations), to a new folder under the session's shared one.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.functions import scalars
from foldline.operators import inference, lookups, metrics, text, validate
from foldline.operators.settled import settled
from foldline.plans import tables
from foldline.plans.registry import query, rounded
from foldline.sources import readers, sinks


def new_folder(spark: SparkSession, name: str) -> str:
    settled(spark.range(1))  # names the session's shared folder, if need be
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def nations(spark: SparkSession, sf: str) -> list[dict]:
    """The nations: 25 rows at every scale."""
    return [r.asDict() for r in tables.read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


def regions(spark: SparkSession, sf: str) -> list[dict]:
    """The regions: 5 rows at every scale."""
    return [r.asDict() for r in tables.read(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()]


def zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members.items():
            archive.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def json_lines(rows: list[dict]) -> bytes:
    return "".join(json.dumps(r) + "\n\n" for r in rows).encode()


# ---- scans


@query
def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Nations from JSON lines with blank lines between."""
    folder = new_folder(spark, "jsonl")
    sinks.put(spark, f"{folder}/nation.jsonl", json_lines(nations(spark, sf)))
    return readers.read_jsonl(spark, f"{folder}/nation.jsonl", "n_nationkey long, n_name string, n_regionkey long")


@query
def zip_lines_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Nations from JSON lines inside an archive, with their line numbers."""
    folder = new_folder(spark, "zip")
    sinks.put(spark, f"{folder}/a.zip", zipped({"in/nation.jsonl": json_lines(nations(spark, sf)), "in/other.txt": b"x"}))
    lines = readers.read_zip_lines(spark, f"{folder}/a.zip", "in/nation.jsonl")
    return lines.select(F.col("line_no"), F.from_json("line", "n_nationkey long, n_name string").alias("r")).select("line_no", "r.*")


def csv_bytes(rows: list[dict], mark: bool) -> bytes:
    names = list(rows[0])
    lines = [",".join(names)] + [",".join('"' + str(r[n]).replace('"', '""') + '"' for n in names) for r in rows]
    return (b"\xef\xbb\xbf" if mark else b"") + "\r\n".join(lines).encode()


@query
def zip_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Nations from CSV with a byte-order mark inside an archive, all text."""
    folder = new_folder(spark, "zipcsv")
    sinks.put(spark, f"{folder}/a.zip", zipped({"nation.csv": csv_bytes(nations(spark, sf), mark=True)}))
    return readers.read_zip_csv(spark, f"{folder}/a.zip", "nation.csv", ["n_nationkey", "n_name", "n_regionkey"]).drop("archive")


@query
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' segments as lists through the CSV sink, with a byte-order mark, and back: lists come back as JSON text."""
    folder = new_folder(spark, "csv")
    rows = tables.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"), F.count("*").alias("n"))
    sinks.write_csv(rows, f"{folder}/out", ["c_nationkey", "segments", "n"], require_rows=True, mark=True)
    return readers.read_csv(spark, f"{folder}/out")


@query
def config_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Regions from one JSON list over several lines."""
    folder = new_folder(spark, "config")
    sinks.put(spark, f"{folder}/c.json", validate.canonical(regions(spark, sf)).encode())
    return readers.read_json(spark, f"{folder}/c.json", "r_regionkey long, r_name string")


@query
def record_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Regions from one JSON file each, known by the file's name."""
    folder = new_folder(spark, "records")
    for r in regions(spark, sf):
        sinks.put(spark, f"{folder}/region_{r['r_regionkey']}.json", validate.canonical({"name": r["r_name"], "length": len(r["r_name"])}).encode())
    return readers.read_record_files(spark, folder, "name string, length long")


def sample_archives(spark: SparkSession, sf: str, folder: str) -> dict[str, str]:
    """Archives of the nations under `folder`, one nested in another, one broken; the digests of two files among them."""
    lines, listed = json_lines(nations(spark, sf)), csv_bytes(nations(spark, sf), mark=False)
    inner = zipped({"deep/nation.csv": listed, "nation.jsonl": lines})
    sinks.put(spark, f"{folder}/outer.zip", zipped({"inner.zip": inner, "../escape": b"x", "note": b"y"}))
    sinks.put(spark, f"{folder}/sub/copy.jsonl", lines)
    sinks.put(spark, f"{folder}/sub/far/copy.jsonl", lines)
    return {"nation.csv": hashlib.sha256(listed).hexdigest(), "nation.jsonl": hashlib.sha256(lines).hexdigest()}


@query
def staged_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Where two files were found by their digests, and what was staged of them: the shallowest place counts, nested archives are opened."""
    folder = new_folder(spark, "stage")
    wanted = sample_archives(spark, sf, f"{folder}/in")
    places = sinks.stage(spark, f"{folder}/in", wanted, f"{folder}/raw")
    found = spark.createDataFrame([(n, p[p.index("/in/") + 4 :]) for n, p in sorted(places.items())], "name string, place string")
    staged = sinks.file_digests(spark, f"{folder}/raw").select(F.col("path").alias("name"), "sha256")
    want = spark.createDataFrame(sorted(wanted.items()), "name string, want string")
    return found.join(staged, "name").join(want, "name").select("name", "place", (F.col("sha256") == F.col("want")).alias("whole"))


@query
def input_verification(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with files against the digests expected of them, archives' members included."""
    folder = new_folder(spark, "verify")
    wanted = sample_archives(spark, sf, folder)
    outer = spark.read.format("binaryFile").load(f"{folder}/outer.zip").select(F.sha2("content", 256).alias("s")).first()["s"]
    sinks.put(spark, f"{folder}/changed.csv", b"a,b\n")
    return readers.verified(spark, folder, {"outer.zip": outer, "changed.csv": wanted["nation.csv"], "lost.csv": wanted["nation.csv"]})


@query
def run_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Folders that hold any file of a run, and what they lack."""
    folder = new_folder(spark, "runs")
    for r in regions(spark, sf):
        for name in ("manifest.json", "records.json")[: 1 + r["r_regionkey"] % 2]:
            sinks.put(spark, f"{folder}/run_{r['r_regionkey']}/{name}", b"{}")
    found = readers.discover_runs(spark, folder, ["manifest.json", "records.json"])
    return found.select(F.regexp_extract("run", r"([^/]+)$", 1).alias("run"), "files", F.array_join("missing", ",").alias("missing"))


@query
def output_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every input and output, as the audit's manifest holds them."""
    folder = new_folder(spark, "manifest")
    for r in regions(spark, sf):
        sinks.put(spark, f"{folder}/in/{r['r_regionkey']}.txt", r["r_name"].encode())
        sinks.put(spark, f"{folder}/out/sub/{r['r_regionkey']}.txt", r["r_name"].lower().encode())
    sinks.audit_manifest(spark, f"{folder}/in", f"{folder}/out")
    read = readers.read_json(spark, f"{folder}/out/manifest.json", "inputs map<string,string>, outputs map<string,string>")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("files")) for s in ("inputs", "outputs")])
    return read.select(F.inline(sides)).select("side", F.explode("files").alias("path", "sha256"))


# ---- lookups


@query
def calendar_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The link of every order's day, from a calendar that is a JSON list; days that it lacks have none."""
    orders = tables.read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    meeting = F.struct(F.date_format("day", "yyyy-MM-dd").alias("meeting_date"), F.concat(F.lit("https://example.org/"), F.date_format("day", "yyyyMMdd")).alias("decision_url"))
    days = orders.select("day").distinct().where(F.dayofweek("day").isin(2, 5))
    # One list a month, so that no row holds a calendar without bound.
    lists = days.groupBy(F.date_trunc("month", "day").alias("month")).agg(F.to_json(F.collect_list(meeting)).alias("raw"))
    calendar = lists.select(F.inline(lookups.json_list(F.col("raw"), "meeting_date:string,decision_url:string")))
    return orders.join(calendar, F.date_format("day", "yyyy-MM-dd") == F.col("meeting_date"), "left").select("o_orderkey", "decision_url")


@query
def annotation_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations from JSON maps keyed by opaque ids, flattened to the columns of each axis and joined to their documents."""
    docs = tables.read(spark, sf, "documents").select("doc_id", scalars.opaque_id("T-", "salt", "|", F.col("doc_id").cast("string")).alias("item_id"))
    score = F.col("doc_id") % 3 - 1
    axes = {}
    for a, shift in (("demand", 0), ("prices", 1)):
        value = ((score + 1 + shift) % 3 - 1).cast("int")
        axes[a] = F.struct(
            value.alias("score"), F.when(value != 0, F.concat(F.lit(a), F.lit(" "), F.col("doc_id"))).alias("evidence"), F.when(value == 0, "not named").alias("zero_reason"), F.when(F.col("doc_id") % 5 == 0, "see file").alias("note")
        )
    kind = "struct<" + ",".join(f"{a}:struct<score:int,evidence:string,zero_reason:string,note:string>" for a in axes) + ">"
    entry = F.struct("item_id", F.struct(*[v.alias(a) for a, v in axes.items()]).alias("v"))
    kept = docs.where(F.col("doc_id") % 7 != 0)
    maps = kept.groupBy(F.substring("item_id", 1, 4).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("raw"))
    told = maps.select(F.inline(readers.keyed_json(F.col("raw"), kind)))
    flat = told.select(F.col("key").alias("item_id"), *[F.col(f"value.{a}.{f}").alias(f"{a}_{f}") for a in axes for f in ("score", "evidence", "zero_reason", "note")])
    return docs.join(flat, "item_id", "left")


@query
def prepared_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as features and targets, some spoilt: what each one's problem is."""
    docs = tables.statements(spark, sf)
    kind = F.col("doc_id") % 13
    action = (F.col("doc_id") % 3 - 1) * 25
    sign = F.when(action < 0, "cut").when(action > 0, "hike").otherwise("hold")
    sha = F.sha2(F.when(kind == 1, F.lit("x")).otherwise(F.col("text")).cast("binary"), 256)
    left = docs.where(kind != 2).select("doc_id", "text", sha.alias("text_sha256"), (F.col("doc_id") * 10).alias("origin"))
    left = left.unionByName(left.where(F.col("doc_id") % 13 == 6))
    right = docs.where(kind != 3).select(
        "doc_id", action.alias("action"), F.when(kind == 4, "hike!").otherwise(sign).alias("direction"), F.when(kind == 5, F.col("doc_id") * 10).otherwise(F.col("doc_id") * 10 + 3).alias("published")
    )
    return lookups.prepared(left, right, "doc_id")


@query
def aligned_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Positions at which two tables of documents don't name the same one."""
    docs = tables.read(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("position"))
    other = docs.where(F.col("doc_id") % 17 != 0).withColumn("doc_id", F.when(F.col("doc_id") % 19 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")))
    return lookups.alignment_errors(docs, other, "doc_id", "position")


@query
def record_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Requests, records and sources by id, equal in index and text hash or not."""
    docs = tables.statements(spark, sf).select("doc_id", F.col("doc_id").alias("index"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    kind = F.col("doc_id") % 11
    records = docs.where(kind != 1).select("doc_id", F.when(kind == 2, F.col("index") + 1).otherwise(F.col("index")).alias("index"), "text_sha256")
    sources = docs.where(kind != 3).select("doc_id", F.when(kind == 4, F.lit("")).otherwise(F.col("text_sha256")).alias("text_sha256"), "index")
    return lookups.checked_records(docs, records, sources, "doc_id", ("index", "text_sha256"))


@query
def prediction_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions whose stored truth isn't that of their origin."""
    truth = tables.observed(spark, sf).select("series", "i", F.col("direction").alias("true_class"), F.col("action_bp").alias("true_bp"), F.col("target_pub").alias("pub"))
    told = tables.predictions(spark, sf).select("series", "i", "arm", "true_class", "true_bp")
    spoilt = told.withColumn("true_bp", F.when((F.col("i") % 9 == 0) & (F.col("arm") == "shrunk"), F.col("true_bp") + 1).otherwise(F.col("true_bp")))
    spoilt = spoilt.withColumn("key", F.concat_ws("|", "series", "i"))
    source = truth.withColumn("key", F.concat_ws("|", "series", "i"))
    joined = spoilt.join(source.select("key", F.col("true_class").alias("s_class"), F.col("true_bp").alias("s_bp")), "key", "left")
    problem = F.when(F.col("s_class").isNull(), "no_source").when(~F.col("true_class").eqNullSafe(F.col("s_class")), "differs:true_class").when(~F.col("true_bp").eqNullSafe(F.col("s_bp")), "differs:true_bp")
    return joined.select("series", "i", "arm", problem.alias("problem")).where("problem IS NOT NULL")


@query
def label_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels from text, aligned by index and split; U is uncertain."""
    docs = tables.axis_labels(spark, sf).select("doc_id", "split")
    first = F.when(F.col("first").isNull(), "U").otherwise(F.col("first").cast("string"))
    told = tables.axis_labels(spark, sf).where(F.col("doc_id") % 6 != 0).select(
        "doc_id", F.when(F.col("doc_id") % 8 == 0, "elsewhere").otherwise(F.col("split")).alias("split"),
        F.when(F.col("doc_id") % 10 == 1, "7").otherwise(first).alias("first"), F.when(F.col("doc_id") % 4 == 1, " ").otherwise(F.col("second").cast("string")).alias("second"),
    )
    return lookups.aligned_labels(told, docs, "doc_id", ("first", "second"), ("split",))


# ---- embeddings


def origins_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return tables.statements(spark, sf).select(F.col("doc_id").alias("position"), F.concat(F.lit("d"), F.col("doc_id")).alias("origin_id"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "doc_id")


@query
def embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with a cache of vectors against the origins, in order: lost, moved, stale, cut and broken ones."""
    origins = origins_in_order(spark, sf)
    kind = F.col("doc_id") % 12
    vector = F.col("embedding").cast("array<double>")
    vectors = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), vector.alias("vector"))
    cache = origins.join(vectors, "doc_id").where(kind != 1).select(
        F.when(kind == 2, F.col("position") + 1).otherwise(F.col("position")).alias("position"), "origin_id", F.when(kind == 3, F.lit("old")).otherwise(F.col("text_sha256")).alias("text_sha256"),
        F.when(kind == 4, F.slice("vector", 1, 63)).when(kind == 5, F.transform("vector", lambda x, k: F.when(k == 0, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("vector")).alias("vector"),
    )
    return lookups.stored_vectors(cache, origins.drop("doc_id"), "origin_id", "position", 64)


def build_vectors(spark: SparkSession, sf: str, backend: str) -> DataFrame:
    """(doc_id, vector) from a backend: stored, the table that stands for an encoder's output, or hash, signed token hashing."""
    if backend == "stored":
        return tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    if backend == "hash":
        return text.hash_embeddings(tables.statements(spark, sf)).withColumnRenamed("embedding", "vector")
    raise ValueError(f"no such backend: {backend}")


@query
def embedding_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the hash backend, written and read again: each document's number of filled positions, and whether the stored digest is that of what was read."""
    folder = new_folder(spark, "vectors")
    made = build_vectors(spark, sf, "hash").join(origins_in_order(spark, sf), "doc_id")
    made.select("position", "origin_id", "text_sha256", "vector").write.parquet(f"{folder}/matrix")
    read = spark.read.parquet(f"{folder}/matrix")
    meta = {"backend": "hash", **lookups.vector_digest(read, ("position", "origin_id")).first().asDict()}
    sinks.put(spark, f"{folder}/meta.json", validate.canonical(meta).encode())
    told = readers.read_json(spark, f"{folder}/meta.json", "backend string, n long, sha256 string")
    again = lookups.vector_digest(read, ("position", "origin_id")).select("n", "sha256", F.lit(True).alias("same"))
    match = told.join(again, ["n", "sha256"], "left").select("backend", F.coalesce("same", F.lit(False)).alias("exact_match"))
    filled = read.select("origin_id", F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("filled"))
    return filled.join(F.broadcast(match))  # one row


@query
def backend_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and widths of the vectors of both backends."""
    rows = [build_vectors(spark, sf, b).select(F.lit(b).alias("backend"), F.size("vector").alias("width")) for b in ("stored", "hash")]
    return rows[0].unionByName(rows[1]).groupBy("backend", "width").agg(F.count("*").alias("n"))


@query
def chunk_pooling(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' vectors from their tokens' in overlapping chunks: means of tokens within a chunk, unweighted means of chunks, length 1."""
    codes = F.transform(scalars.words(F.col("text")), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    docs = tables.statements(spark, sf).select("doc_id", codes.alias("ids")).where("size(ids) > 0")
    cut = docs.select("doc_id", F.posexplode(text.chunks(F.col("ids"), 62, 8)).alias("chunk", "ids"))
    # A token's vector is four digits of its code; a chunk's mean is taken within the row.


    def mean(d: int) -> Column:
        return F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + F.floor(x / 10**d).cast("long") % 10) / F.size("ids")

    means = cut.select("doc_id", "chunk", F.array(*map(mean, range(4))).alias("vector"))
    pooled = text.mean_vector(means, ["doc_id"], "vector")
    return rounded(pooled.select("doc_id", F.posexplode("vector").alias("pos", "value")), "value")


# ---- integrity


@query
def bundle_check(spark: SparkSession, sf: str) -> DataFrame:
    """A bundle's members against its manifest."""
    members = tables.statements(spark, sf).select(F.concat(F.lit("records/"), F.col("doc_id"), F.lit(".json")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id")
    manifest = members.where(F.col("doc_id") % 14 != 1).withColumn("sha256", F.when(F.col("doc_id") % 14 == 2, F.lit("0")).otherwise(F.col("sha256")))
    return lookups.manifest_errors(members.where(F.col("doc_id") % 14 != 3), manifest)


@query
def envelope_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Content-addressed envelopes, some spoilt: what is wrong with each."""
    kind = F.col("doc_id") % 8
    body = F.concat(F.lit('{\n  "axis": "demand",\n  "n": '), F.col("doc_id"), F.lit("\n}\n"))
    sha = F.sha2(body.cast("binary"), 256)
    data = F.concat(F.lit('{"n": '), F.when(kind == 1, F.col("doc_id") + 1).otherwise(F.col("doc_id")), F.lit(', "axis": "demand"}'))
    task = F.concat(F.lit("task-"), F.col("doc_id"))
    raw = F.concat(F.lit('{"task": "'), F.when(kind == 2, "task-x").otherwise(task), F.lit('", "identity": {}, "sha": "'), sha, F.lit('", "data": '), data, F.when(kind == 3, F.lit("")).otherwise(F.lit("}")))
    rows = tables.read(spark, sf, "documents").select("doc_id", task.alias("task"), F.when(kind != 4, raw).alias("raw"))
    return validate.envelope_errors(rows, "raw", "task").select("doc_id", "error")


@query
def run_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """A run of two families, two seeds and all documents, some records lost, repeated or changed."""
    docs = tables.read(spark, sf, "documents").select("doc_id")
    grid = validate.expected_identities(docs, {"family": ["base", "tuned"], "seed": [0, 1]}, "doc_id")
    kind = F.col("doc_id") % 15
    spoilt = (F.col("seed") == 1) & (F.col("family") == "tuned")
    records = grid.where(~((kind == 1) & spoilt)).withColumn("run", F.lit("r1")).withColumn("target_sha", F.when((kind == 2) & spoilt, F.lit("other")).otherwise(F.md5(F.col("doc_id").cast("string"))))
    records = records.unionByName(records.where((kind == 3) & spoilt)).unionByName(records.where((kind == 4) & spoilt).withColumn("seed", F.lit(9)))
    records = records.withColumn("run", F.when((F.col("doc_id") % 30 == 4) & (F.col("seed") == 9), "r2").otherwise(F.col("run")))
    return lookups.run_errors(records, grid, ("family", "seed", "doc_id"), "run", "target_sha", "doc_id")


@query
def blind_separation(spark: SparkSession, sf: str) -> DataFrame:
    """A blind table against its private counterpart."""
    rows = tables.axis_labels(spark, sf).select("doc_id", "split", "first")
    private = rows.where(F.col("doc_id") % 16 != 1)
    blind = rows.where(F.col("doc_id") % 16 != 2).select("doc_id", F.when(F.col("doc_id") % 16 == 3, "lost").otherwise(F.col("split")).alias("split"), F.lit(None).cast("int").alias("first"))
    return lookups.separation_errors(blind, private, "doc_id", ("split",), ("first", "second"))


@query
def stored_hash_check(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose stored text hash is stale."""
    rows = tables.statements(spark, sf).withColumn("stored", F.sha2(F.when(F.col("doc_id") % 9 == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")).cast("binary"), 256))
    return validate.stored_hash_errors(rows, "text", "stored", ["doc_id"])


@query
def training_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each fold's training set that are evaluated in folds of their own."""
    from foldline.operators import folds

    data = tables.observed(spark, sf)
    at = tables.folds(data)
    learned = folds.training_pairs(at, data).select("series", "fold", "j")
    evaluated = at.select("series", F.col("i").alias("j"))
    asked = learned.select("series", "j").intersect(evaluated)
    return learned.join(asked, ["series", "j"], "left_semi").groupBy("series", "fold").agg(F.count("*").alias("shared"), F.max("j").alias("latest"))


@query
def agreement_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.axis_labels(spark, sf)
    return metrics.agreement(rows, ("split",), "first", "first_repeat")


def prose_answers(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, family, raw): answers in prose, some strict, some fenced, some broken."""
    kind = F.col("doc_id") % 7
    body = F.concat(
        F.lit('{"demand": '), (F.col("doc_id") % 3 - 1).cast("string"), F.when(kind == 1, ', "demand": 0').otherwise(""), F.when(kind == 5, F.lit(', "pri\\u0063es": ')).otherwise(F.lit(', "prices": ')),
        F.when(kind == 2, "0.0").otherwise("1"), F.lit("}"),
    )
    raw = F.when(kind == 3, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 4, F.concat(F.lit("{} "), body)).when(kind == 6, F.concat(F.lit(" \n"), body, F.lit("\t"))).otherwise(body)
    family = F.when(F.col("doc_id") % 2 == 0, "base").otherwise("tuned")
    return tables.read(spark, sf, "documents").select("doc_id", family.alias("family"), raw.alias("raw"))


@query
def first_object_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in prose: the object at the first brace, strictly."""
    return validate.parse_first_objects(prose_answers(spark, sf).drop("family"), "raw", ("demand", "prices")).drop("raw")


@query
def strict_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of each family: how many there are, how many hold a valid object, and how many are nothing else."""
    parsed = validate.parse_first_objects(prose_answers(spark, sf), "raw", ("demand", "prices"))
    return parsed.groupBy("family").agg(F.count("*").alias("answers"), F.count("strict").alias("valid"), F.count_if(F.col("strict")).alias("strict"))


@query
def probability_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions whose probabilities are spoilt: out of range, or not of sum 1."""
    rows = tables.predictions(spark, sf).select("series", "i", "arm", "p_cut", "p_hold", "p_hike")
    spoilt = rows.withColumn("p_cut", F.when(F.col("i") % 10 == 1, F.col("p_cut") + 0.25).when(F.col("i") % 10 == 2, F.lit(float("nan"))).otherwise(F.col("p_cut")))
    spoilt = spoilt.withColumn("p_hike", F.when(F.col("i") % 10 == 3, F.col("p_hike") - 1.0).otherwise(F.col("p_hike")))
    return validate.probability_violations(spoilt, ["p_cut", "p_hold", "p_hike"]).select("series", "i", "arm")


@query
def named_reference_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of named differences between families under two references: the first rating, and it where both ratings agree."""
    from foldline.plans import catalogue

    at = catalogue.labelled_positions(spark, sf)
    both = tables.axis_labels(spark, sf).where("first IS NOT NULL AND first <=> first_repeat").select("doc_id", F.lit(True).alias("_b"))
    rows = catalogue.seeded_runs(spark, sf).join(at, "doc_id").join(both, "doc_id", "left")
    refs = F.array(F.struct(F.lit("full").alias("reference"), F.col("truth").alias("t")), F.struct(F.lit("common").alias("reference"), F.when(F.col("_b"), F.col("truth")).alias("t")))
    rows = rows.select("idx", "seed", "axis", "predicted", F.inline(refs)).withColumnRenamed("t", "truth")
    rows = rows.withColumn("family", F.element_at(F.array(F.lit("base"), F.lit("tuned"), F.lit("retuned")), F.col("seed") + 1))
    scores = inference.masked_resampled(rows, at.count(), 100, 3, ("reference", "family"))
    pairs = {"tuning": ("tuned", "base"), "retuning": ("retuned", "tuned"), "both": ("retuned", "base")}
    return rounded(inference.named_contrasts(scores, "family", pairs, ("reference",)), "low", "high")


@query
def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """The nations in the order in which Python's generator shuffles them under a seed."""
    rows = nations(spark, sf)
    order = inference.seeded_order(spark, len(rows), 20260923)
    return order.join(tables.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("item"), "n_name"), "item").select("position", "n_name")


@query
def packet_items(spark: SparkSession, sf: str) -> DataFrame:
    """The items of an annotators' packet: opaque ids, and comments that may stand inside a page's script."""
    rows = tables.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("position"), scalars.opaque_id("B-", "20260923", ":", F.col("n_name")).alias("item_id"), F.concat(F.lit("</script>"), F.col("n_name")).alias("text"))
    page = sinks.annotator_packet(rows, "<script>const items = /*ITEMS*/;</script>")
    listed = json.loads(page.removeprefix("<script>const items = ").removesuffix(";</script>"))
    back = spark.createDataFrame([(r["item_id"], r["text"], page.count("</script>")) for r in listed], "item_id string, told string, ends int")
    return rows.join(back, "item_id").select("item_id", sinks.embedded(F.col("text")).alias("embedded"), (F.col("told") == F.col("text")).alias("reads_back"), "ends")
