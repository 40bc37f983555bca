"""Headers found by tasks, sheets of any width, and windows of any length."""

import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.config import TrainConfig
from marketloom.operators import forecast as fc
from marketloom.sinks import tables as sinks
from marketloom.sources.csv import header_lines, read_daily, read_named_csv


def test_a_folder_of_many_files(spark, tmp_path):
    for i in range(1200):
        header, row = ("date,symbol,O,H,L,C,V,VAL", f"2024-01-02,s{i},1,2,1,1,{i},5") if i % 3 else ("symbol,VAL,V,date,O,H,L,C", f"s{i},5,{i},2024-01-02,1,2,1,1")
        (tmp_path / f"{i}.csv").write_text(f"{header}\r\n{row}\r\n", encoding="utf-8")
    got = {r.symbol: (r.V, r.VAL, r.H) for r in read_daily(spark, str(tmp_path)).collect()}
    assert got == {f"s{i}": (i, 5, 2) for i in range(1200)}
    plan = header_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "file_block_start" in plan


@pytest.mark.parametrize("toggle", [False, True])
def test_headers_that_differ_in_quotes_and_blanks(spark, tmp_path, toggle):
    (tmp_path / "a.csv").write_text(' A ,"b"\n1,2\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("b,x\n3,4\nb,x\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("only\n", encoding="utf-8")
    rows = read_named_csv(spark, str(tmp_path), toggle).collect()
    got = sorted((r.a or "", r.b or "", r.x or "") for r in rows)
    # A line that repeats the header is one for the quote-toggling reader, a row for the other.
    assert got == ([("", "3", "4"), ("1", "2", "")] if toggle else [("", "3", "4"), ("", "b", "x"), ("1", "2", "")])


def read_sheet(path):
    lines = [line for part in sorted(path.glob("part-*")) for line in part.read_text(encoding="utf-8").splitlines()]
    return list(csv.reader(lines))


def test_sheet_of_many_labels(spark, tmp_path):
    n = 50_000
    cells = spark.range(n).select(
        (F.col("id") % 3).cast("string").alias("r"), F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("c"),
        (F.col("id") * 0.5 + 1).alias("v"),
    )
    sinks.write_matrix(cells, "r", "c", "v", str(tmp_path / "sheet"))
    header, *rows = read_sheet(tmp_path / "sheet")
    assert header == ["r", *[f"c{i:06d}" for i in range(n)]]
    assert [r[0] for r in rows] == ["0", "1", "2"]
    for k, r in enumerate(rows):
        x = np.array(r[1:], float)
        expected = np.where(np.arange(n) % 3 == k, np.arange(n) * 0.5 + 1, 0.0)
        assert (x == expected).all()


def test_sheet_of_odd_cells(spark, tmp_path):
    rows = [("b", "x,y", 1.0), ("b", "x,y", 3.0), ("b", "x,y", None), ("a", 'q"', float("inf")), ("a", "z", -2.0), (None, "z", 9.0), ("a", None, 9.0), ("c", "é", float("nan"))]
    df = spark.createDataFrame(rows, "r string, c string, v double").repartition(4)
    sinks.write_matrix(df, "r", "c", "v", str(tmp_path / "sheet"))
    assert read_sheet(tmp_path / "sheet") == [
        ["r", 'q"', "x,y", "z", "é"], ["a", "0.0", "0.0", "-2.0", "0.0"], ["b", "0.0", "3.0", "0.0", "0.0"], ["c", "0.0", "0.0", "0.0", "0.0"]
    ]
    sinks.write_matrix(df.limit(0), "r", "c", "v", str(tmp_path / "none"))
    assert read_sheet(tmp_path / "none") == [["r"]]


@pytest.mark.parametrize(("window", "half_life"), [(30, 0.05), (30, 8.0), (7, 0.01)])
def test_windows_far_longer_than_their_half_life(spark, window, half_life):
    rng = np.random.default_rng(2)
    days, v = 70, rng.normal(size=(70, 3)).round(3)
    v[:, 2] = np.arange(70) % 4
    gram = spark.createDataFrame([(None, t, v[t].tolist()) for t in range(days)], "dt date, t int, gram array<double>")
    got = {r.t: r.gram for r in fc.trailing_gram(gram, TrainConfig(window=window, half_life=half_life)).collect()}
    for t in range(days):
        span = np.arange(max(0, t - window), t)
        n = v[span, 2].sum()
        assert (t in got) == (n > 0)
        if n > 0:
            w = 2.0 ** ((span - (t - 1)) / half_life)
            assert got[t] == pytest.approx([*(w[:, None] * v[span, :2]).sum(axis=0), n], rel=1e-9, abs=1e-12)


def test_stage_tables_are_dropped_together(spark, tmp_path, monkeypatch):
    from marketloom import session

    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    table = session.stage(spark.range(5), "five")
    assert table.count() == 5 and len(list(tmp_path.glob("marketloom/*/five-*"))) == 1
    session.drop_stages(spark)
    assert not list(tmp_path.glob("marketloom/*"))
    assert session.stage(spark.range(3), "three").count() == 3
