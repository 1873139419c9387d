"""Scans with declared schemas; nothing is inferred."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines are no rows, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole-file JSON: an object is a row, an array a row for each element."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text; a byte-order mark before the first name is dropped."""
    found = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return found.toDF(*[c.lstrip(BOM) for c in found.columns])


def read_record_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One JSON object a file, with record_id from the file's name."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return spark.read.schema(schema).option("multiLine", True).json(pattern).select(name.alias("record_id"), "*")


def read_zip_lines(spark: SparkSession, pattern: str, member: str) -> DataFrame:
    """(archive, line_no, line): non-blank lines of one member of each archive. Archives can't be split: one task reads each whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as file:
                    lines = [(path, k, line.rstrip("\r\n")) for k, line in enumerate(io.TextIOWrapper(file, "utf-8-sig")) if line.strip()]
                yield pd.DataFrame(lines, columns=["archive", "line_no", "line"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(run, "archive string, line_no long, line string")


def read_zip_csv(spark: SparkSession, pattern: str, member: str, columns: Sequence[str]) -> DataFrame:
    """(archive, line_no, columns...) of a CSV member with a header, all text; a byte-order mark is dropped. A column that the header lacks is an error.

    Archives can't be split: one task reads each whole, and gives its rows in batches.
    """
    names = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as file:
                    rows = csv.DictReader(io.TextIOWrapper(file, "utf-8-sig", newline=""))
                    if lacking := set(names) - set(rows.fieldnames or ()):
                        raise ValueError(f"{member} lacks {sorted(lacking)}")
                    held = []
                    for k, row in enumerate(rows):
                        held.append((path, k, *[row[c] for c in names]))
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=["archive", "line_no", *names])
                            held = []
                yield pd.DataFrame(held, columns=["archive", "line_no", *names])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(run, "archive string, line_no long, " + ", ".join(f"`{c}` string" for c in names))


def archive_members(spark: SparkSession, pattern: str) -> DataFrame:
    """(archive, sha256, member, bytes, problem) of every member; problem names unsafe or repeated names and failing checksums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, digest, content in zip(batch["path"], batch["sha256"], batch["content"], strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    broken, seen = archive.testzip(), set()
                    for info in archive.infolist():
                        name = info.filename
                        parts = name.replace("\\", "/").split("/")
                        problem = "unsafe" if name.startswith(("/", "\\")) or ".." in parts else "repeated" if name in seen else "checksum" if name == broken else None
                        seen.add(name)
                        rows.append((path, digest, name, info.file_size, problem))
                yield pd.DataFrame(rows, columns=["archive", "sha256", "member", "bytes", "problem"])

    files = spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"), "content")
    return files.mapInPandas(run, "archive string, sha256 string, member string, bytes long, problem string")


def keyed_json(raw: Column, value_schema: str) -> Column:
    """A JSON object keyed by ids as an array of (key, value) entries, to be exploded."""
    return F.map_entries(F.from_json(raw, T._parse_datatype_string(f"map<string,{value_schema}>")))


def staged(files: DataFrame) -> DataFrame:
    """(sha256, path) of the shallowest, then first, path of each content: `files` is (path, sha256)."""
    depth = F.size(F.split("path", "/"))
    return files.groupBy("sha256").agg(F.min_by("path", F.struct(depth, F.col("path"))).alias("path"))


def hidden_files(spark: SparkSession, root: str, wanted: dict[str, str]) -> DataFrame:
    """(name, path, inside, depth) of every file under `root`, or inside ZIP archives there at any depth, whose SHA-256 `wanted` names.

    `wanted` maps names to digests; inside is the path through nested archives, empty for a plain file. One task reads an archive whole.
    """
    names = {digest: name for name, digest in wanted.items()}

    def found(path: str, inside: tuple[str, ...], data: bytes) -> Iterator[tuple]:
        name = names.get(hashlib.sha256(data).hexdigest())
        if name is not None:
            yield name, path, "!".join(inside), path.count("/") + sum(x.count("/") + 1 for x in inside)
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                for info in archive.infolist():
                    if not info.is_dir():
                        yield from found(path, (*inside, info.filename), archive.read(info))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, data in zip(batch["path"], batch["content"], strict=True) for r in found(path, (), bytes(data))]
            yield pd.DataFrame(rows, columns=["name", "path", "inside", "depth"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    return files.mapInPandas(run, "name string, path string, inside string, depth long")


def best_sources(found: DataFrame) -> DataFrame:
    """The shallowest, then first by path, place of each name that `hidden_files` found."""
    best = F.min(F.struct("depth", "path", "inside")).alias("b")
    return found.groupBy("name").agg(best).select("name", "b.path", "b.inside", "b.depth")


def verified(spark: SparkSession, root: str, expected: dict[str, str]) -> DataFrame:
    """(name, problem) of what is wrong with the files directly under `root`: missing, sha256 differs, or a problem of an archive's members."""
    want = spark.createDataFrame(sorted(expected.items()), "name string, want string")
    files = spark.read.format("binaryFile").load(root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("got"))
    both = want.join(files, "name", "left")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("want"), "sha256 differs")
    plain = both.select("name", problem.alias("problem")).where("problem IS NOT NULL")
    zips = [n for n in expected if n.endswith(".zip")]
    if not zips:
        return plain
    members = archive_members(spark, f"{root}/*.zip").where("problem IS NOT NULL")
    named = members.select(F.regexp_extract("archive", r"([^/]+)$", 1).alias("name"), F.concat(F.col("problem"), F.lit(": "), F.col("member")).alias("problem"))
    return plain.unionByName(named.where(F.col("name").isin(zips)))


def discover_runs(spark: SparkSession, root: str, required: list[str]) -> DataFrame:
    """(run, files, missing): folders under `root` that hold any file, how many, and which required names they lack."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("run"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    runs = parts.groupBy("run").agg(F.count("*").alias("files"), F.collect_set(F.when(F.col("name").isin(required), F.col("name"))).alias("held"))
    return runs.select("run", "files", F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.col("held"))).alias("missing"))


def read_config(path: str) -> dict:
    """A small JSON configuration, on the driver."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)
