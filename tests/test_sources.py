"""Readers, writers and the streaming form."""

from __future__ import annotations

import json
import zipfile

import pytest
from conftest import SMALL

from foldline.sources import readers, sinks
from foldline.streaming import availability


def test_csv_round_trip_and_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 0.25], 'a "quoted", text'), (2, None, None)], "k int, p array<double>, t string")
    path = str(tmp_path / "out")
    sinks.write_csv(df, path, single_file=True)
    back = {r["k"]: r for r in readers.read_csv(spark, path).collect()}
    assert json.loads(back["1"]["p"]) == [0.5, 0.25] and back["1"]["t"] == 'a "quoted", text' and back["2"]["t"] is None
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv(df, path)
    sinks.write_csv(df, path, ["k"], overwrite=True)
    assert readers.read_csv(spark, path).columns == ["k"]


def test_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,x\n1, 2 \n2,\n".encode())
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).columns == ["id", "x"]


def test_json_and_archives(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n{"id": "y"}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int").count() == 2
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "o1.json").write_text('{"status": "valid"}')
    assert readers.read_record_files(spark, str(tmp_path / "r"), "status string").first()["record_id"] == "o1"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.jsonl", '{"id": 1}\n\n{"id": 2}\n')
        z.writestr("../bad", "x")
    lines = readers.read_zip_lines(spark, str(tmp_path / "z.zip"), "in/a.jsonl").collect()
    assert [r["line"] for r in lines] == ['{"id": 1}', '{"id": 2}']
    problems = {r["member"]: r["problem"] for r in readers.archive_members(spark, str(tmp_path / "z.zip")).collect()}
    assert problems == {"in/a.jsonl": None, "../bad": "unsafe"}


def test_staging_takes_the_shallowest_path(spark):
    files = spark.createDataFrame([("/a/b/x", "s"), ("/a/y", "s"), ("/a/x", "s"), ("/q", "t")], "path string, sha256 string")
    assert {tuple(r) for r in readers.staged(files).collect()} == {("s", "/a/x"), ("t", "/q")}


def test_bundle_and_same_csv(tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("a")
    sinks.bundle(str(tmp_path / "f"), str(tmp_path / "b.zip"))
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        assert sorted(z.namelist()) == ["a.txt", "manifest.json"]
    with pytest.raises(FileExistsError):
        sinks.bundle(str(tmp_path / "f"), str(tmp_path / "b.zip"))
    assert sinks.same_csv(b"\xef\xbb\xbfa,b\r\n1,2\r\n", b"a,b\n1,2") and not sinks.same_csv(b"a", b"b")
    assert sinks.markdown_table([{"a": 1, "b": 0.5}, {"a": None, "b": None}], ["a", "b"]).count("\n") == 4


def test_streamed_rates_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = availability.bucket_rates(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, availability.bucket_rates(events).collect()))


def test_runs_report_what_they_lack(spark, tmp_path):
    for name in ("a/manifest.json", "a/x.json", "b/c/x.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    made = {r["run"].rsplit("/", 1)[1]: (r["files"], r["missing"]) for r in readers.discover_runs(spark, str(tmp_path), ["manifest.json", "x.json"]).collect()}
    assert made == {"a": (2, []), "c": (1, ["manifest.json"])}


def test_csv_inside_an_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.csv", "\ufeffid,x,y\r\n1,\"a, b\",\r\n2,\"line\nbreak\",é\r\n".encode())
    made = readers.read_zip_csv(spark, str(tmp_path / "z.zip"), "a.csv", ["x", "id"]).select("line_no", "id", "x").collect()
    assert sorted(map(tuple, made)) == [(0, "1", "a, b"), (1, "2", "line\nbreak")]
    with pytest.raises(Exception, match="lacks"):
        readers.read_zip_csv(spark, str(tmp_path / "z.zip"), "a.csv", ["q"]).collect()


def test_staging_refuses_what_is_nowhere(spark, tmp_path):
    import hashlib

    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "d" / "x").write_bytes(b"content")
    found = {"a": hashlib.sha256(b"content").hexdigest()}
    assert sinks.stage(spark, str(tmp_path / "in"), found, str(tmp_path / "raw"))["a"].endswith("/d/x")
    assert (tmp_path / "raw" / "a").read_bytes() == b"content" and [p.name for p in (tmp_path / "raw").iterdir() if not p.name.startswith(".")] == ["a"]
    with pytest.raises(FileNotFoundError, match="lost"):
        sinks.stage(spark, str(tmp_path / "in"), found | {"lost": "0"}, str(tmp_path / "raw2"))
    assert not (tmp_path / "raw2").exists()


def test_files_are_put_whole_over_old_ones(spark, tmp_path):
    for data in (b"old", b"new and longer", b""):
        sinks.put(spark, str(tmp_path / "f" / "x.bin"), data)
        assert (tmp_path / "f" / "x.bin").read_bytes() == data


def test_csv_guards_and_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "k int, t string")
    with pytest.raises(ValueError, match="no rows"):
        sinks.write_csv(df.limit(0), str(tmp_path / "none"), require_rows=True)
    sinks.write_csv(df, str(tmp_path / "m"), single_file=True, mark=True)
    written = next((tmp_path / "m").glob("*.csv")).read_bytes()
    assert written.startswith(b"\xef\xbb\xbfk,t") and readers.read_csv(spark, str(tmp_path / "m")).columns == ["k", "t"]


def test_a_packet_needs_its_mark_once(spark):
    items = spark.createDataFrame([(1, "b", "</script>"), (0, "a", "x")], "position int, item_id string, text string")
    page = sinks.annotator_packet(items, "<script>/*ITEMS*/</script>")
    assert page.count("</script>") == 1 and [r["item_id"] for r in json.loads(page[8:-9])] == ["a", "b"]
    with pytest.raises(ValueError, match="once"):
        sinks.annotator_packet(items, "nothing")
