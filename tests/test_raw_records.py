import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import raw_records as R

ID = "123-456-789-012-345"
AT = dt.datetime(2024, 1, 1)


def tables(spark, files, records):
    e = spark.createDataFrame([(fo, f, 2000 + i, AT + dt.timedelta(days=i), d, h) for i, (fo, f, d, h) in enumerate(files)], "_source_folder string, _source_file string, file_year int, exported_at timestamp, delim string, header_text string")
    r = spark.createDataFrame([(i, fo, f, i, t, AT) for i, (fo, f, t) in enumerate(records)], "raw_id long, _source_folder string, _source_file string, record_no long, raw_text string, read_at timestamp")
    return r, e


def reasons(spark, header, texts, delim=","):
    r, e = tables(spark, [("a", "f", delim, header)], [("a", "f", t) for t in texts])
    out = {x["raw_id"]: x["fail_reason"] for x in R.load_records(r, e).collect()}
    return [out[i] for i in range(len(texts))]


def slow_reason(text, n, delim):
    """Quoting and count by reading characters, as a check of the patterns."""
    text = (text or "").rstrip("\r\n")
    fields, i = 0, 0
    while True:
        fields += 1
        if text[i : i + 1] == '"':
            i += 1
            while True:
                k = text.find('"', i)
                if k < 0:
                    return "broken_quoting"
                if text[k + 1 : k + 2] == '"':
                    i = k + 2
                    continue
                i = k + 1
                break
            if i < len(text) and text[i] != delim:
                return "broken_quoting"
        else:
            k = text.find(delim, i)
            i = len(text) if k < 0 else k
        if i >= len(text):
            break
        i += 1
    return "too_many_fields" if fields > n else "too_few_fields" if fields < n else None


def test_reasons(spark):
    many = [f"{ID},t{i},{i},1/2/2020,yes" for i in range(30)]
    got = reasons(spark, '"Lens ID","Title","N","Day","Flag"', many + [
        f'{ID},"a ""q"" b",1,2020-02-29,No', f'{ID},"a,1,2020-02-29,no', f'{ID},"a" x,1,2/3/2020,no', f"{ID},a,1,2/3/2020", f"{ID},a,1,2/3/2020,no,", f"{ID},a,1,30/2/2020,no",
        f"{ID},a,1x,2/3/2020,no", f"{ID},a,1,2/3/2020,maybe", "12-3,a,1,2/3/2020,no", ",a,1,2/3/2020,no", f' {ID} ,a "b" c\\,, ,\r\n', "", None, f'{ID},"line\nbreak",2,,\n',
    ])[30:]
    assert got == [None, "broken_quoting", "broken_quoting", "too_few_fields", "too_many_fields", "invalid_value", "invalid_value", "invalid_value", "invalid_value", "invalid_value", None, "too_few_fields", "too_few_fields", None]


def test_decimal_takes_whole_numbers(spark):
    assert reasons(spark, "Lens ID;X", [f"{ID};{i}.5" for i in range(20)] + [f"{ID};7", f"{ID};.5", f"{ID};-1"], ";")[20:] == [None, "invalid_value", "invalid_value"]


def test_missing_header_and_empty_tables(spark):
    r, e = tables(spark, [], [("a", "f", "x")])
    assert [x["fail_reason"] for x in R.load_records(r, e).collect()] == ["too_many_fields"]
    r, e = tables(spark, [("a", "f", ",", "Lens ID")], [])
    assert R.load_records(r, e).count() == 0
    assert R.layout_changes(r, e).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text('a",\n ;', max_size=14), min_size=1, max_size=30))
def test_structure_against_brute_force(spark, texts):
    r, e = tables(spark, [("a", "f", ",", "X,Y")], [("a", "f", t) for t in texts])
    got = {x["raw_id"]: x["reason"] for x in R.split_records(r, e).collect()}
    assert [got[i] for i in range(len(texts))] == [slow_reason(t, 2, ",") for t in texts]


def test_very_long_field(spark):
    long = 'x""y' * 20_000
    assert reasons(spark, "Lens ID,T", [f'{ID},"{long}"', f'{ID},"{long}'])[0] is None


def test_corrupt_text_is_kept(spark):
    r, e = tables(spark, [("a", "f", ",", "Lens ID,T")], [("a", "f", f'{ID},"x\n'), ("a", "f", f"{ID},y")])
    rows = {x["raw_id"]: x for x in R.load_records(r, e).collect()}
    assert rows[0]["_corrupt_record"] == f'{ID},"x\n' and rows[0]["fields"] is None
    assert rows[1]["_corrupt_record"] is None and rows[1]["fields"] == [ID, "y"]


def layouts():
    colours = ["red", "green", "blue", "grey", "black"]
    a = [f"{ID},{colours[i % 5]},{i % 7},2/{1 + i % 12}/2000" for i in range(60)]
    b = [f"{i % 7},{colours[(i + 1) % 5]},{ID},{2001 + 0}-0{1 + i % 9}-11" for i in range(60)]
    c = [f"{i % 7} cells,{colours[(i + 2) % 5]},{ID},2002-0{1 + i % 9}-11,{'yes' if i % 2 else 'no'}" for i in range(60)]
    files = [("a", "1.csv", ",", '﻿"Lens ID" , Colour,Count,Day\r'), ("a", "2.csv", ",", "Count,Paint,Lens ID,Day"), ("a", "3.csv", ",", "Count,Paint,Lens ID,day,Sold")]
    return files, [("a", f"{n}.csv", t) for n, rows in ((1, a), (2, b), (3, c)) for t in rows]


def test_layout_changes(spark):
    got = {tuple(x[1:]) for x in R.layout_changes(*tables(spark, *layouts())).collect()}
    assert got == {
        ("2.csv", "renamed", "Colour", "Paint"), ("2.csv", "retyped", "Day", "Day"),
        ("3.csv", "renamed", "Day", "day"), ("3.csv", "added", "Sold", "Sold"), ("3.csv", "retyped", "Count", "Count"),
    }


def test_unified_table(spark):
    x = R.unified_table(*tables(spark, *layouts()))
    assert dict(x.dtypes)["Day"] == "date" and dict(x.dtypes)["Sold"] == "boolean" and dict(x.dtypes)["Count"] == "struct<whole:decimal(38,0),text:string,canonical:string>"
    rows = {r["raw_id"]: r for r in x.collect()}
    assert len(rows) == 180 and x.columns == ["raw_id", "_source_folder", "_source_file", "Lens ID", "Colour", "Count", "Day", "Sold"]
    assert rows[0]["Colour"] == "red" and rows[0]["Day"] == dt.date(2000, 1, 2) and rows[0]["Count"]["whole"] == 0 and rows[0]["Count"]["text"] is None and rows[0]["Sold"] is None
    assert rows[179]["Count"]["text"] == rows[179]["Count"]["canonical"] == "3 cells" and rows[179]["Count"]["whole"] is None and rows[179]["Sold"] is True


def test_a_name_that_comes_back_is_another_field(spark):
    files = [("a", "1", ",", "Lens ID,Name"), ("a", "2", ",", "Lens ID,Title"), ("a", "3", ",", "Lens ID,Title,Name")]
    words = ["red cell", "green cell", "blue cell", "grey cell", "black cell"]
    rows = [("a", "1", f"{ID},{words[i % 5]}") for i in range(40)] + [("a", "2", f"{ID},{words[i % 5]}") for i in range(40)] + [("a", "3", f"{ID},{words[i % 5]},{i}") for i in range(40)]
    r, e = tables(spark, files, rows)
    assert {tuple(x[1:]) for x in R.layout_changes(r, e).collect()} == {("2", "renamed", "Name", "Title"), ("3", "added", "Name", "Name")}
    x = R.unified_table(r, e)
    assert x.columns[3:] == ["Lens ID", "Name", "Name (2)"] and dict(x.dtypes)["Name (2)"] == "decimal(38,0)"
    got = {row["raw_id"]: row for row in x.collect()}
    assert len(got) == 120 and got[0]["Name"] == got[80]["Name"] == "red cell" and got[0]["Name (2)"] is None and got[81]["Name (2)"] == 1


def test_a_header_may_repeat_a_name(spark):
    r, e = tables(spark, [("a", "1", ",", "Lens ID,X,X,x"), ("b", "1", ",", "X,lens_id,Y")], [("a", "1", f"{ID},{i},t{i},") for i in range(20)] + [("b", "1", f"{i}.5,{ID},z") for i in range(20)])
    x = R.unified_table(r, e)
    assert x.columns[3:] == ["Lens ID", "X", "X (2)", "x (3)", "Y"] and dict(x.dtypes)["X"] == "double"  # fields of both folders meet by name
    rows = {row["raw_id"]: row for row in x.collect()}
    assert len(rows) == 40 and rows[3]["X"] == 3.0 and rows[3]["X (2)"] == "t3" and rows[3]["x (3)"] is None and rows[23]["X"] == 3.5 and rows[23]["Y"] == "z" and rows[23]["Lens ID"] == ID
    assert R.layout_changes(r, e).count() == 0


def test_fields_that_leave_and_return():
    f = lambda file, names, **renames: {"file": file, "names": names, "types": {}, "renames": renames}
    got = R.follow_fields([f(1, ["a", "b"]), f(2, ["b"]), f(3, ["a", "b"]), f(4, ["b", "c"], c="a"), f(5, ["a", "b", "c"])])
    assert [(x.name, x.at) for x in got] == [("a", {1: 0, 3: 0, 4: 1, 5: 2}), ("b", {1: 1, 2: 0, 3: 1, 4: 0, 5: 1}), ("a", {5: 0})]


def test_failing_records_are_those_that_do_not_load(spark, data):
    raw, files = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("raw_records", "export_files"))
    loaded = {x["raw_id"]: x["fail_reason"] for x in R.load_records(raw, files).collect()}
    assert {x["raw_id"]: x["fail_reason"] for x in R.failing_records(raw, files).collect()} == {k: v for k, v in loaded.items() if v} and len(loaded) == raw.count()
    table = R.unified_table(raw, files)
    assert {x["raw_id"] for x in table.collect()} == {k for k, v in loaded.items() if not v}


def test_clashing_extra_columns(spark):
    r, e = tables(spark, *layouts())
    r = r.selectExpr("*", "1 as names", "2 as fields", "3 as delim")
    assert R.load_records(r, e).where("fail_reason is null").count() == 180


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p3_types", "p3_table", "p5_loaded"])
def test_queries_run(spark, data, name):
    from corpusloom.plans.queries import QUERIES

    assert QUERIES[name](spark, data).count() > 0
