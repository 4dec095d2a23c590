"""Reading of well files, and sinks."""

import datetime as dt
import json

import pytest

from fluvion.sources import files


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_well_history(spark, tmp_path):
    path = write(tmp_path / "h.csv", "DATA;well;TYPE;WLPR;WWIR;Unnamed: 5\n01.02.2020; 14.0 ; prod ;1.5;x;9\n01.02.2020;14;INJ;2;3;9\n31.02.2020;14;PROD;1;1;9\n01.03.2020;;PROD;1;1;9\n15.03.2020;A-1;inj;;4;9\n;;;;;\n")
    rows = files.well_history(spark, path).orderBy("date").collect()
    assert [(r["well"], r["date"], r["type"], r["wlpr"], r["wwir"]) for r in rows] == [("14", dt.date(2020, 2, 1), "PROD", 1.5, None), ("A-1", dt.date(2020, 3, 15), "INJ", None, 4.0)]
    assert "unnamed: 5" not in rows[0].asDict()


def test_places(spark, tmp_path):
    table = write(tmp_path / "t.csv", "Well,X,y,z\n1.0,10,20,-5\nB,1,,x\n")
    assert sorted((r["well"], r["x"], r["y"], r["z"]) for r in files.places_table(spark, table).collect()) == [("1", 10.0, 20.0, -5.0), ("B", 1.0, None, None)]
    with pytest.raises(ValueError):
        files.places_table(spark, write(tmp_path / "u.csv", "well,x\n1,2\n"))
    text = write(tmp_path / "t.txt", "-- comment\n\n'1' 10  20 -5\nshort 1 2\n  7\t1 2 3 4\n")
    assert sorted((r["well"], r["x"], r["z"]) for r in files.places_text(spark, text).collect()) == [("1", 10.0, -5.0), ("7", 1.0, 3.0)]


def test_distance_matrix_with_fallbacks(spark, tmp_path):
    m = files.distance_matrix(spark, write(tmp_path / "m.csv", "Well,1,2.0,x,Unnamed: 4\n1,0,5,7,7\n2,,0,7,7\n"))
    assert sorted((r["src"], r["dst"], r["d"]) for r in m.collect()) == [("1", "1", 0.0), ("1", "2", 5.0), ("2", "2", 0.0)]
    pairs = spark.createDataFrame([("1", "2", 9.0), ("2", "1", 9.0), ("1", "3", 9.0)], "prod_id string, inj_id string, d double")
    got = {(r["prod_id"], r["inj_id"]): r["distance_m"] for r in files.with_distance(pairs, m).collect()}
    assert got == {("1", "2"): 5.0, ("2", "1"): 5.0, ("1", "3"): 9.0}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", {"p": 4.0}, float("nan"))], "k string, params map<string,double>, v double")
    files.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first()["params"] == '{"p":4.0}'
    files.write_parquet(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert json.loads(files.metrics_json(df.drop("params"))) == [{"k": "a", "v": None}]
    assert files.flattened({"a": {"b": 1, "c": [1, 2]}, "d": 2}) == {"a.b": 1, "a.c": "[1, 2]", "d": 2}


def test_reports_of_any_size(spark, tmp_path):
    with pytest.raises(ValueError):
        files.metrics_json(spark.range(5), most=4)
    files.write_json(spark.range(5), str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 5
    train = spark.createDataFrame([("a", dt.date(2020, 1, 1)), ("b", dt.date(2020, 2, 1))], "well string, ds date")
    tree = files.run_metadata({"horizon": 6}, train, train.where("well = 'a'"), "well", "ds")
    assert tree["train"] == {"rows": 2, "keys": 2, "first": "2020-01-01", "last": "2020-02-01"}
    files.write_document(spark, tree, str(tmp_path / "meta"))
    assert json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "meta")).collect())) == tree
    report = spark.createDataFrame([("rows", "", 4.0), ("negative", "v", 1.0), ("gaps", "well", 0.0)], "check string, column string, value double")
    assert files.quality_document(report) == {"checks": {"rows": {"all": 4.0}, "negative": {"v": 1.0}, "gaps": {"well": 0.0}}, "issues": ["negative v"], "passed": False}


def test_documents_are_found_converted_and_skipped(spark, tmp_path):
    (tmp_path / "docs" / "deep").mkdir(parents=True)
    for name in ("a.HTML", "deep/b.html", "deep/c.bin"):
        write(tmp_path / "docs" / name, "<p>x</p>")
    found = files.discovered(spark, str(tmp_path / "docs"))
    assert sorted((r["name"], r["extension"], r["size"]) for r in found.collect()) == [("a.HTML", "html", 8), ("b.html", "html", 8)]
    docs = spark.createDataFrame([("1", "x"), ("2", None), ("3", "y")], "path string, markdown string")
    made, report = files.converted(docs, docs.where("path = '3'"), lambda d: d)
    assert {r["path"]: r["status"] for r in report.collect()} == {"1": "ok", "2": "failed", "3": "skipped"} and made.count() == 1


def test_cache(spark, tmp_path):
    cache = files.Cache(spark, str(tmp_path / "cache"))
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cache.made(make, "rows", a=1, b="x").count() == 3
    assert len(made) == 1 and cache.get("rows", a=2) is None
    cache.clear()
    assert cache.get("rows", a=1, b="x") is None


def test_validation_raises(spark):
    from fluvion.operators import quality

    df = spark.createDataFrame([("a", "PROD", 1.0), (None, "WELL", -1.0)], "well string, type string, wlpr double")
    with pytest.raises(quality.ValidationError) as caught:
        quality.require_valid(df, ["well", "ds"], ["PROD"], nonnegative=["wlpr"])
    assert {(c, n) for c, n, _ in caught.value.failures} == {("null", "well"), ("missing", "ds"), ("domain", "type"), ("negative", "wlpr")}
    good = df.where("well = 'a'")
    assert quality.require_valid(good, ["well"], ["PROD"], nonnegative=["wlpr"]) is good
    places = spark.createDataFrame([("a", 1.0, None, 1.0), ("b", 1.0, 1.0, 1.0)], "well string, x double, y double, z double")
    assert quality.require_places(places, "well") is places
    for bad in (places.drop("z"), places.unionByName(places)):
        with pytest.raises(quality.ValidationError):
            quality.require_places(bad, "well")
