"""Writers: CSV with nested values as JSON, canonical JSON, Markdown, and manifests of what was written."""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.operators.validate import canonical
from foldline.sources import readers


def write_csv(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, overwrite: bool = False, single_file: bool = False, require_rows: bool = False, mark: bool = False
) -> None:
    """CSV with a header; arrays, maps and structs become JSON text. An existing path is an error unless `overwrite`.

    `single_file` sends all rows to one task: for reports whose size is known to be small. `require_rows` makes an empty table an error
    (ValueError); `mark` puts a byte-order mark before the first name.
    """
    if require_rows and df.isEmpty():
        raise ValueError("no rows to write")
    kept = df.select(*(columns or df.columns))
    if mark:
        kept = kept.withColumnRenamed(kept.columns[0], "\ufeff" + kept.columns[0])
    flat = kept.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in kept.dtypes])
    out = flat.coalesce(1) if single_file else flat
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def write_json(value: object, path: str) -> str:
    """Canonical JSON on the driver; returns its SHA-256."""
    data = canonical(value).encode("utf-8")
    Path(path).write_bytes(data)
    return hashlib.sha256(data).hexdigest()


def markdown_table(rows: Sequence[dict], columns: Sequence[str], digits: int = 4) -> str:
    """A Markdown table of a few collected rows; doubles with so many decimals."""

    def cell(v: object) -> str:
        return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]]) + "\n"


def manifest(folder: str, name: str = "manifest.json") -> dict[str, str]:
    """SHA-256 of every file under a local folder but the manifest, which is written there."""
    root = Path(folder)
    found = {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*")) if p.is_file() and p.name != name}
    write_json(found, str(root / name))
    return found


def bundle(folder: str, archive: str) -> None:
    """A local folder with its manifest as a ZIP; never over an existing one."""
    manifest(folder)
    with zipfile.ZipFile(archive, "x", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(Path(folder).rglob("*")):
            if path.is_file():
                out.write(path, path.relative_to(folder))


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in any file system that Spark knows, whole or not at all: written beside its place, then moved there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = files.create(beside, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if files.exists(target):
        files.delete(target, False)
    if not files.rename(beside, target):
        files.delete(beside, False)
        raise OSError(f"{path} could not be put in place")


def read_member(data: bytes, inside: str) -> bytes:
    """What stands at a path through nested archives, as `readers.hidden_files` names it; the data itself for an empty one."""
    for member in inside.split("!") if inside else ():
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            data = archive.read(member)
    return data


def stage(spark: SparkSession, root: str, wanted: dict[str, str], folder: str) -> dict[str, str]:
    """Find files of these digests under `root`, directly or in nested archives, and put each in `folder` under its name; returns where each was.

    The shallowest, then first place counts. A digest found nowhere is an error (FileNotFoundError), before anything is put. Files are few and
    small enough for the driver: they are inputs of a study, not its tables.
    """
    places = {r["name"]: r for r in readers.best_sources(readers.hidden_files(spark, root, wanted)).collect()}
    if lost := sorted(set(wanted) - set(places)):
        raise FileNotFoundError(f"nowhere under {root}: {lost}")
    for name, r in places.items():
        content = spark.read.format("binaryFile").load(r["path"]).select("content").first()["content"]
        data = read_member(bytes(content), r["inside"])
        if hashlib.sha256(data).hexdigest() != wanted[name]:
            raise OSError(f"{name} changed while it was staged")
        put(spark, f"{folder}/{name}", data)
    return {name: r["path"] + ("!" + r["inside"] if r["inside"] else "") for name, r in places.items()}


def file_digests(spark: SparkSession, folder: str, leave: Sequence[str] = ()) -> DataFrame:
    """(path, sha256) of every file under a folder of any file system, paths from there, but those whose name is in `leave`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = folder.rstrip("/").split(":")[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_extract("path", r"^\w+:/+(.*)$", 1), f"^.*?{re.escape(base)}/+", "")
    return files.select(path.alias("path"), F.sha2("content", 256).alias("sha256")).where(~F.regexp_extract("path", r"([^/]+)$", 1).isin(*leave, ""))


def audit_manifest(spark: SparkSession, inputs: str, outputs: str, name: str = "manifest.json") -> dict:
    """{inputs, outputs}: the digests of every file under both folders, written as `name` to the second; for folders of reports."""
    found = {
        side: {r["path"]: r["sha256"] for r in file_digests(spark, folder, (name,)).orderBy("path").collect()} for side, folder in (("inputs", inputs), ("outputs", outputs))
    }
    put(spark, f"{outputs}/{name}", canonical(found).encode())
    return found


def embedded(text: Column) -> Column:
    """Text that may stand inside a script element of a page: every < is written as its JSON escape."""
    return F.replace(text, F.lit("<"), F.lit("\\u003c"))


def annotator_packet(items: DataFrame, template: str, mark: str = "/*ITEMS*/") -> str:
    """A page for annotators: the items (item_id, text, in the order of position) as JSON in place of the template's mark. Items are as many as a person reads."""
    if template.count(mark) != 1:
        raise ValueError(f"the template must hold {mark} once")
    rows = items.orderBy("position").select("item_id", "text").collect()
    body = json.dumps([r.asDict() for r in rows], ensure_ascii=False).replace("<", "\\u003c")
    return template.replace(mark, body)


def same_csv(a: bytes, b: bytes) -> bool:
    """Whether two CSV files are byte-equal but for line ends, a final line end and a byte-order mark."""

    def plain(x: bytes) -> bytes:
        return x.removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n").removesuffix(b"\n")

    return plain(a) == plain(b)
