import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import folders, sinks
from corpusloom.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "2011.csv").write_text('#,Lens ID,Title,X\n1,a,"two\nlines",1\n2,b,"say ""hi""",2\n3,c,long,1,EXTRA\n4,d,short\n', encoding="utf-8")
    (tmp_path / "2012.CSV").write_text("#,Lens ID,Title,Y\n1,e,t,9\n", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("x")
    return str(tmp_path)


def test_scan(spark, folder):
    rows, bad, failed = folders.scan(spark, folder, "by_filing")
    assert rows.columns == ["#", "Lens ID", "Title", "_source_folder", "_source_file"] and failed == []
    assert {(r["Lens ID"], r["Title"]) for r in rows.collect()} == {("a", "two\nlines"), ("b", 'say "hi"'), ("d", "short"), ("e", "t")}
    assert [r["_source_file"] for r in bad.collect()] == ["2011.csv"]
    assert {r["_source_file"]: r["n_rows"] for r in folders.row_counts(rows).collect()} == {"2011.csv": 3, "2012.CSV": 1}


def test_an_empty_field_too_many_is_bad(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n3,4,\n5,\n,6\n"",7,""\n8\n')
    got = {(r["x"], r["y"]): r["_bad"] for r in folders.read_file(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {("1", "2"): False, ("3", "4"): True, ("5", None): False, (None, "6"): False, (None, "7"): True, ("8", None): False}


def test_scan_log_and_file_sample(spark, folder):
    rows, bad, failed = folders.scan(spark, folder, "s")
    log = {r["_source_file"]: (r["n_rows"], r["n_bad"], r["error"]) for r in folders.scan_log(rows, bad, [*failed, ("/x/broken.csv", "why")]).collect()}
    assert log == {"2011.csv": (3, 1, None), "2012.CSV": (1, 0, None), "broken.csv": (0, 0, "why")}
    assert [f.rsplit("/", 1)[1] for f in folders.files_of(folder, 1)] == ["2011.csv"] and folders.scan(spark, folder, "s", 1)[0].count() == 3


def test_chunks_resume(spark, tmp_path):
    p, seen = str(tmp_path / "chunks"), []
    double = lambda x: x.withColumn("v", F.col("id") * 2)
    assert sinks.append_chunks(spark.range(50), double, p, "id", limit=20, tell=seen.append) == 20
    assert {r["id"] for r in spark.read.parquet(p).collect()} == set(range(20))
    assert sinks.append_chunks(spark.range(50), double, p, "id", chunks=4, tell=seen.append) == 30
    assert sinks.append_chunks(spark.range(50), double, p, "id") == 0
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(p).collect()) == [(i, 2 * i) for i in range(50)]
    assert seen[-1]["done"] == seen[-1]["total"] == 30 and seen[-1]["seconds_left"] == 0


def test_progress():
    from corpusloom.functions.stats import progress

    assert progress(50, 200, 5.0) == {"done": 50, "total": 200, "per_second": 10.0, "seconds_left": 15.0}
    assert progress(0, 10, 0.0)["seconds_left"] is None


def test_a_labelled_sheet_is_not_overwritten(spark, tmp_path):
    p = str(tmp_path / "sheet")
    x = spark.range(3).withColumns({"label": F.lit(""), "notes": F.lit("")})
    sinks.write_sheet(x, p, ["label", "notes"])
    sinks.write_sheet(x, p, ["label", "notes"])  # nothing is filled in yet
    sinks.write_csv(x.withColumn("label", F.when(F.col("id") == 1, "Y").otherwise("")), p)
    with pytest.raises(FileExistsError):
        sinks.write_sheet(x, p, ["label", "notes"])


def test_odd_types_become_text(spark, tmp_path):
    x = spark.range(1).select("id", F.lit(None).alias("v"), F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.lit("r").alias("#"))
    out = sinks.write_parquet(x, str(tmp_path / "t"))
    assert dict(out.dtypes) == {"id": "bigint", "v": "string", "m": "string"} and out.first()["m"] == '{"a":1}'


def test_drift(spark, folder):
    assert len(folders.schema_groups(folder)) == 2
    assert folders.drift(folder) == (["#", "Lens ID", "Title"], {"X": ["2011.csv"], "Y": ["2012.CSV"]})


def test_head_and_prune(spark, folder):
    good, n_bad, first = folders.head(spark, f"{folder}/2011.csv", 3)
    assert good.count() == 2 and n_bad == 1 and json.loads(first)["Lens ID"] == "c"
    assert folders.head(spark, f"{folder}/2012.CSV")[1:] == (0, None)
    assert folders.prune(good, lambda c: "Lens" in c).columns == ["Lens ID"] and folders.column_with(good, "Tit") == "Title"
    with pytest.raises(KeyError):
        folders.column_with(good, "CPC")


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        folders.files_of(str(tmp_path))


@pytest.mark.parametrize("enc, text", [("utf-8", "é"), ("utf-8-sig", "é"), ("cp1252", "é"), ("latin-1", "\x81é")])
def test_encodings(spark, tmp_path, enc, text):
    p = tmp_path / "s.csv"
    p.write_bytes(f"a,b\n{text},1\n".encode(enc))
    assert folders.encoding_of(p.read_bytes()) == enc
    assert folders.read_small(spark, str(p)).first()[0] == text


def test_sinks(spark, tmp_path, folder):
    rows, bad, _ = folders.scan(spark, folder, "s")
    out = sinks.write_parquet(rows.withColumn("v", F.lit(None)), str(tmp_path / "p"))
    assert "#" not in out.columns and out.count() == 4
    sinks.write_csv(rows.withColumn("l", F.array(F.lit(1))), str(tmp_path / "c"))
    sinks.write_lines(bad, str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b")).count() == 1
    sinks.write_manifest(str(tmp_path / "m.json"), n=1)
    assert sinks.read_manifest(str(tmp_path / "m.json")) ["n"] == 1 and sinks.read_manifest(str(tmp_path / "none")) == {}
    assert json.loads((tmp_path / "m.json").read_text())["n"] == 1


def test_resume_by_id(spark, tmp_path):
    p = str(tmp_path / "r")
    assert sinks.append_missing(spark.range(5), p, "id") == 5
    assert sinks.append_missing(spark.range(8), p, "id") == 3
    assert sinks.append_missing(spark.range(8), p, "id") == 0
    assert spark.read.parquet(p).count() == 8


def test_cached_stage(spark, tmp_path):
    calls = []
    build = lambda: (calls.append(1), spark.range(2))[1]
    p = str(tmp_path / "stage")
    assert sinks.cached_stage(spark, p, build).count() == sinks.cached_stage(spark, p, build).count() == 2 and len(calls) == 1
    sinks.cached_stage(spark, p, build, refresh=True)
    assert len(calls) == 2


def test_stream_ingest(spark, tmp_path):
    rows = [(i % 5, dt.datetime(2024, 1, 1, 0, i)) for i in range(10)]
    spark.createDataFrame(rows, "id int, ts timestamp").write.parquet(str(tmp_path / "in"))
    s = ingest.stream_parquet(spark, str(tmp_path / "in"), "id int, ts timestamp")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):  # a restart adds nothing
        ingest.ingest_available(s, lambda x: ingest.first_seen(x, "id", "ts", "1 hour"), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_stream_windows(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, h)) for h in (0, 0, 1, 9)]
    spark.createDataFrame(rows, "k string, ts timestamp").write.parquet(str(tmp_path / "in"))
    s = ingest.windowed_counts(ingest.stream_parquet(spark, str(tmp_path / "in"), "k string, ts timestamp"), "ts", "k", "1 hour", "10 minutes")
    ingest.ingest_available(s, lambda x: x, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert sum(r["n"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) >= 0


def test_report(spark, tmp_path):
    sinks.write_report(str(tmp_path / "r.txt"), ["a", "b"])
    assert (tmp_path / "r.txt").read_text() == "a\nb"
