"""Spreadsheets, widening, and a whole run from files to files."""

import datetime
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from fluvion.operators import folds, global_model, injection, panel, quality, run
from fluvion.sources import sheets


def month(k):
    return datetime.date(2000 + k // 12, 1 + k % 12, 1)


def workbook(path, rows, name="Wells", shared=("well", "X", "y", "z"), more=""):
    """rows: lists of cells as XML, each with its reference or none."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {link}><sheets><sheet name="Other" sheetId="1" r:id="r1"/><sheet name="{name}" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}<si><r><t>A</t></r><r><t>-1</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData>{''.join(rows)}</sheetData>{more}</worksheet>")
    return str(path)


HEAD = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="E1" t="s"><v>3</v></c></row>'


def test_sheets_have_types_blanks_and_gaps(spark, tmp_path):
    path = workbook(tmp_path / "p.xlsx", [
        HEAD,
        '<row r="2"><c r="A2"><v>14</v></c><c r="B2"><v>1.5</v></c><c r="C2"/><c r="E2"><v>-2.5E3</v></c></row>',
        '<row r="4"><c r="A4" t="s"><v>4</v></c><c r="B4" t="b"><v>1</v></c><c r="C4" t="inlineStr"><is><t>no number</t></is></c><c r="D4"><v>99</v></c><c r="E4" t="e"><v>#N/A</v></c></row>',
        '<row><c t="str"><v>B</v></c><c><v>3</v></c></row>',
        '<row r="9"><c r="B9"><v>7</v></c></row>',
    ])
    got = {(r["row"], r["column"]): (r["text"], r["number"]) for r in sheets.cells(spark, path, "Wells").collect()}
    assert got[2, 0] == (None, 14.0) and got[4, 0] == ("A-1", None) and got[4, 1] == (None, 1.0) and got[5, 0] == ("B", None) and got[5, 1] == (None, 3.0) and (2, 2) not in got
    rows = {r["row"]: tuple(r)[1:] for r in sheets.table(spark, path, 1).collect()}
    assert rows == {2: ("14", "1.5", None, "-2500"), 4: ("A-1", "1", "no number", "#N/A"), 5: ("B", "3", None, None), 9: (None, "7", None, None)}
    assert {tuple(r) for r in sheets.places_sheet(spark, path, 1).collect()} == {("14", 1.5, None, -2500.0), ("A-1", 1.0, None, None), ("B", 3.0, None, None)}
    assert sheets.cells(spark, path, 0).count() == 0
    with pytest.raises(ValueError):
        sheets.places_sheet(spark, workbook(tmp_path / "q.xlsx", [HEAD], shared=("well", "x", "y", "depth")), 1)
    for bad in (5, "Absent"):
        with pytest.raises(Exception, match="sheet"):
            sheets.cells(spark, path, bad).collect()


def test_sheets_leave_the_task_in_batches(spark, tmp_path, monkeypatch):
    rows = [HEAD, *(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c><c r="B{k}"><v>{k * 2}</v></c></row>' for k in range(2, 3000))]
    path = workbook(tmp_path / "long.xlsx", rows)
    monkeypatch.setattr(sheets, "CELLS", 100)
    found = sheets.table(spark, path, 1).agg(F.count("*"), F.sum(F.col("X").cast("long"))).first()
    assert tuple(found) == (2998, sum(2 * k for k in range(2, 3000)))


def test_wide_blocks_hold_every_series(spark):
    r = random.Random(1)
    rows = [(f"s{k}", month(m), r.uniform(0, 9)) for k in range(23) for m in range(6) if r.random() < 0.7] + [("s3", month(0), 1.0), (None, month(0), 5.0)]
    df = spark.createDataFrame(rows, "well string, ds date, v double").repartition(7)
    names = sorted({w for w, _, _ in rows if w})
    wide, places = panel.widened(df, "well", "ds", "v", 5)
    assert {(x["well"], x["block"], x["place"]) for x in places.collect()} == {(w, k // 5, k % 5) for k, w in enumerate(names)}
    got = {(x["ds"], 5 * x["block"] + j): x[f"v{j}"] for x in wide.collect() for j in range(5) if x[f"v{j}"] is not None}
    want = {}
    for w, d, v in rows:
        if w:
            want[d, names.index(w)] = want.get((d, names.index(w)), 0.0) + v
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert panel.widened(df.where("false"), "well", "ds", "v", 5)[0].count() == 0


def test_quality_report_without_rows_or_columns(spark):
    df = spark.createDataFrame([("a", month(0), None), ("a", month(1), None)], "well string, ds date, v double")
    assert {(r["check"], r["column"]): r["value"] for r in quality.quality_report(df, "well", "ds", ["v"]).collect()}["outliers", "v"] == 0
    assert quality.quality_report(df, "well", "ds", []).count() == 5
    assert {(r["check"], r["column"]): r["value"] for r in quality.quality_report(df.where("false"), "well", "ds", ["v"]).collect()}["rows", ""] == 0


SETTINGS = run.Settings(least=30, samples=5, folds=folds.Settings(horizon=3, step=3, folds=2, window=5, components=2, injection=injection.Settings(top=2), model=global_model.Settings(horizon=3, lags=4, past=("womr",), future=("inj_wwir_lag_weighted",), rounds=4)))


def test_a_run_from_files_to_files(spark, tmp_path):
    r = random.Random(5)
    lines = ["DATA;well;TYPE;WLPR;WOMR;WWIR;WTHP"]
    for k in range(40):
        for n in range(3):
            if (n, k) != (1, 7):
                lines.append(f"01.{month(k):%m.%Y};{n};PROD;{100 + 9 * math.sin(k / 4 + n) + r.uniform(-2, 2):.3f};{60 + r.uniform(-2, 2):.3f};;{80 + r.uniform(-2, 2):.3f}")
        lines.append(f"01.{month(k):%m.%Y};i0;INJ;;;{100 + r.uniform(-30, 30):.3f};90")
        lines.append(f"01.{month(k):%m.%Y};i1;INJ;;;{90 + r.uniform(-30, 30):.3f};")
    lines += [f"01.{month(k):%m.%Y};late;PROD;1;1;0;1" for k in range(20, 30)]
    (tmp_path / "h.csv").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "p.csv").write_text("well,x,y,z\n" + "\n".join(f"{w},{100 * k},{40 * k},-2000" for k, w in enumerate(["0", "1", "2", "i0", "i1", "late"])), encoding="utf-8")
    out = str(tmp_path / "out")
    made = run.run(spark, str(tmp_path / "h.csv"), str(tmp_path / "p.csv"), out, SETTINGS)
    rows = made.merged.collect()
    assert {(x["unique_id"], x["ds"]) for x in rows} == {(str(n), month(k)) for n in range(3) for k in range(37, 40)}
    assert all(x["cp_lo"] <= x["y_hat"] <= x["cp_hi"] and x["q_0.1"] <= x["q_0.9"] for x in rows)
    written = spark.read.csv(f"{out}/predictions", header=True)
    assert written.count() == 9 and {"unique_id", "ds", "y_hat", "q_0.5", "cp_lo", "cp_hi"} <= set(written.columns)
    document = json.loads("\n".join(x["value"] for x in spark.read.text(f"{out}/metrics.json").collect()))
    assert document["overall"]["n"] == 9 and len(document["by_horizon"]) == 3 and len(document["cv_by_fold"]) == 2 and document["train_cutoff"] == str(month(36))
    meta = json.loads("\n".join(x["value"] for x in spark.read.text(f"{out}/metadata.json").collect()))
    assert meta["train"]["rows"] == 3 * 37 and meta["test"]["rows"] == 9
    assert spark.read.json(f"{out}/metrics_by_well").count() == 3
    pairs = spark.read.csv(f"{out}/pair_summary", header=True)
    assert {(x["prod_id"], x["inj_id"]) for x in pairs.collect()} == {(str(n), i) for n in range(3) for i in ("i0", "i1")}
    assert {x["prod_id"] for x in spark.read.parquet(f"{out}/alpha").select("prod_id").distinct().collect()} == {"0", "1", "2"}
    assert json.loads("\n".join(x["value"] for x in spark.read.text(f"{out}/quality.json").collect()))["checks"]
    bad = tmp_path / "bad.csv"
    bad.write_text("\n".join([*lines[:4], "01.01.2001;9;OTHER;1;1;1;1"]), encoding="utf-8")
    with pytest.raises(quality.ValidationError):
        run.run(spark, str(bad), str(tmp_path / "p.csv"), out, SETTINGS)
