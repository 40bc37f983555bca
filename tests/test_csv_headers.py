"""Every CSV file goes by its own header."""

import pytest

from marketloom.sources.csv import read_daily, read_named_csv


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


@pytest.mark.parametrize("toggle", [False, True])
def test_files_with_other_columns_and_orders(spark, tmp_path, toggle):
    put(tmp_path, "a.csv", "C,C1,date\n1,2,2024-01-02\n")
    put(tmp_path, "b.csv", "﻿date, c ,Extra\n2024-01-03,3,x\n")
    put(tmp_path, "c.csv", "")
    put(tmp_path, "d.csv", "date,C,c,C1\n2024-01-04,4,9,5\n")
    got = read_named_csv(spark, str(tmp_path), toggle)
    rows = {r.date: (r.c, r.c1, r.extra) for r in got.collect()}
    assert rows == {"2024-01-02": ("1", "2", None), "2024-01-03": ("3", None, "x"), "2024-01-04": ("4", "5", None)}


def test_daily_files_in_two_column_orders(spark, tmp_path):
    put(tmp_path, "a.csv", "date,symbol,O,H,L,C,V,VAL\n2024-01-02,a,1,2,0.5,1.5,10,15\n")
    put(tmp_path, "b.csv", 'VAL,V,C,L,H,O,Symbol,Date\n"1,500",100,15,5,20,10,b,2024/1/3\n')
    got = {r.symbol: (r.O, r.H, r.L, r.C, r.V, r.VAL) for r in read_daily(spark, str(tmp_path)).collect()}
    assert got == {"a": (1, 2, 0.5, 1.5, 10, 15), "b": (10, 20, 5, 15, 100, 1500)}


def test_no_header_at_all(spark, tmp_path):
    put(tmp_path, "a.csv", "")
    with pytest.raises(ValueError):
        read_named_csv(spark, str(tmp_path))
