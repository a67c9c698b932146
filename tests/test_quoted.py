"""Quoted line breaks: rows equal to those of Python's csv module, from many splits of one file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tripscope.sources import quoted


@pytest.fixture()
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def made(rng, n, end="\n"):
    words = ["plain", "two\nlines", 'a "quoted" word', "comma, and\n\nblank\nlines", '"', '""', "\n", "tail\n", "é漢字", "x" * 400, '\n"\n', "back\\slash", " padded "]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL)
    w.writerow(["id", "note", "more"])
    for i in range(n):
        w.writerow([str(i), rng.choice(words), rng.choice(words)])
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_equal_those_of_csv(spark, small_splits, tmp_path, end):
    rng = random.Random(3)
    want = []
    for k in range(3):
        text = made(rng, 400, end)
        (tmp_path / f"f{k}.csv").write_bytes(text.encode())
        want += [tuple(r) for r in csv.reader(io.StringIO(text, newline=""))][1:]
    paths = [str(tmp_path / f"f{k}.csv") for k in range(3)]
    assert spark.read.text(paths).select(F.col("_metadata.file_block_start")).distinct().count() > 10
    got = [tuple(r) for r in quoted.read_quoted(spark, paths).collect()]
    assert sorted(got) == sorted(want)


def test_one_field_over_many_splits(spark, small_splits, tmp_path):
    field = "\n".join(f"line {i}, with a comma" for i in range(500))
    (tmp_path / "f.csv").write_text(f'a,b\n1,"{field}"\n2,x\n\n3\n')
    assert sorted(map(tuple, quoted.read_quoted(spark, [str(tmp_path / "f.csv")]).collect()), key=str) == [("1", field), ("2", "x"), ("3", None)]


def test_unbalanced_quotes_are_refused(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="unbalanced quotes"):
        quoted.read_quoted(spark, [str(tmp_path / "f.csv")])


def test_heading_only(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n")
    assert quoted.read_quoted(spark, [str(tmp_path / "f.csv")]).collect() == []
