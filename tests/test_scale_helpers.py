"""Exactness of the helpers that keep a hot group out of a single task."""

import math
import random
import struct
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tripscope.functions import ordering, quantiles
from tripscope.operators import cuts
from tripscope.operators import quality as Q
from tripscope.session import ensure_checkpoint_dir, shared_dir


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randint(0, 30)}", i, 42.0 if rng.random() < 0.4 else round(rng.gammavariate(2, 50), 1)) for i in range(20000)]
    return spark.createDataFrame(rows, "g string, id bigint, v double").cache()


def test_percentiles_match_the_plain_form(spark, skewed):
    got = {r.g: (r.n, r.p10, r.p50, r.p99) for r in quantiles.exact_percentiles(skewed, ["g"], "v", [0.1, 0.5, 0.99]).collect()}
    want = {r.g: (r.n, *r.q) for r in skewed.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", [0.1, 0.5, 0.99]).alias("q")).collect()}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g])


def test_percentiles_of_small_and_null_groups(spark):
    for n in range(1, 9):
        df = spark.createDataFrame([(None, float(i * i)) for i in range(n)] + [(None, None)], "g string, v double")
        got = quantiles.exact_percentiles(df, ["g"], "v", [0.25, 0.9]).first()
        want = df.agg(F.percentile("v", [0.25, 0.9]).alias("q")).first().q
        assert got.n == n and (got.p25, got.p90) == pytest.approx(tuple(want))


def test_whole_table_percentiles(spark, skewed):
    got = quantiles.exact_percentiles(skewed, [], "v", [0.5, 0.95]).first()
    want = skewed.agg(F.percentile("v", [0.5, 0.95]).alias("q")).first().q
    assert (got.p50, got.p95) == pytest.approx(tuple(want))


def test_positions_in_a_hot_group(spark, skewed):
    placed = ordering.with_position(skewed, ["g"], [F.col("v").desc(), F.col("id")], partitions=16)
    want = skewed.selectExpr("id", "row_number() over (partition by g order by v desc, id) as w")
    bad = placed.join(want, "id").filter("position <> w").count()
    assert bad == 0 and placed.count() == 20000


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_tiles(spark, skewed, k):
    tiled = ordering.with_tile(skewed, [F.col("v"), F.col("id")], k)
    want = skewed.selectExpr("id", f"ntile({k}) over (order by v, id) as w")
    assert tiled.join(want, "id").filter("tile <> w").count() == 0


def test_more_tiles_than_rows(spark):
    df = spark.range(5).withColumn("v", F.col("id") * 1.0)
    assert sorted(r.tile for r in ordering.with_tile(df, [F.col("v")], 8).collect()) == [1, 2, 3, 4, 5]


def test_by_each_is_one_scan_of_plain_group_bys(spark, skewed):
    df = skewed.withColumn("parity", F.col("id") % 2)
    got = {(r.dimension, r.member): (r.n, r.m) for r in cuts.by_each(df, ["g", "parity"], {"m": "max(v)"}).collect()}
    for d in ("g", "parity"):
        for r in df.groupBy(F.col(d).cast("string").alias("k")).agg(F.count("*").alias("n"), F.max("v").alias("m")).collect():
            assert got[d, r.k] == (r.n, r.m)


def test_column_profile_counts(spark):
    df = spark.createDataFrame([(" a", "1"), ("", "x"), (None, "2"), ("a", "2")], "t string, u string")
    got = {r.column: r for r in Q.column_profile(df, ["t", "u"]).collect()}
    t, u = got["t"], got["u"]
    assert (t.n, t.nulls, t.distinct_values, t.empty, t.padded, t.cast_failures) == (4, 1, 3, 1, 1, 3)
    assert (u.cast_failures, u.distinct_values, u.null_pct) == (1, 3, 0.0)


def test_ordered_bits_are_the_bits_of_the_double(spark):
    rng = random.Random(4)
    numbers = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 0.1, 1 / 3]
    numbers += [s * x for e in range(-1074, 1024, 3) for x in (2.0**e, math.nextafter(2.0**e, 9e307), math.nextafter(2.0**e, 0)) for s in (1, -1)]
    numbers += [rng.gauss(0, 10 ** rng.randint(-5, 9)) for _ in range(2000)]

    def bits(v):
        if math.isnan(v):
            return 0x7FF8 << 48
        whole = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        return -whole if v < 0 else whole

    got = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i int, v double").select("i", quantiles.ordered_bits(F.col("v")).alias("u")).collect()
    assert {r.i: r.u for r in got} == {i: bits(v) for i, v in enumerate(numbers)}


def test_percentiles_where_values_differ_in_their_last_bits_only(spark):
    """All four passes are needed, with negative values, infinities and NaN in between."""
    rows = [("near", math.nextafter(1.0, 2.0) + k * 2.0**-52) for k in range(300)] + [("wide", (-1) ** k * 2.0 ** (k - 150)) for k in range(300)]
    rows += [("odd", x) for x in (float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.0)] + [(None, 2.5), (None, None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ps = [0.0, 0.3, 0.5, 0.77, 1.0]
    names = ["p0", "p30", "p50", "p77", "p100"]
    got = {r.g: [r.n, *[r[c] for c in names]] for r in quantiles.exact_percentiles(df, ["g"], "v", ps).collect()}
    for g in ("near", "wide", None, "odd"):
        values = sorted((v for k, v in rows if k == g and v is not None), key=lambda v: (math.isnan(v), v))
        for p, x in zip(ps, got[g][1:]):
            spot = (len(values) - 1) * p
            low, part = values[math.floor(spot)], spot - math.floor(spot)
            want = low + part * (values[math.floor(spot) + 1] - low) if part else low
            assert x == want or (math.isnan(x) and math.isnan(want)), (g, p, x, want)
    assert "none" not in got


def test_percentiles_order_no_values(spark, skewed):
    """The windows of the selection run over digits; no sort or window has the value in it."""
    text = quantiles.exact_percentiles(skewed, ["g"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "Sort [__v" not in text and "Window [" not in text


def test_percentiles_read_their_input_once(spark):
    """Whatever the passes, expressions and joins behind the rows are done once, and the written rows are deleted."""
    import glob

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    ensure_checkpoint_dir(spark)
    df = spark.range(1000).selectExpr("id % 3 AS g", "1.0D + id * 1e-9D AS v").mapInPandas(counted, "g long, v double")
    got = {r.g: r.p50 for r in quantiles.exact_percentiles(df, ["g"], "v", [0.5]).collect()}
    values = {g: [1.0 + i * 1e-9 for i in range(1000) if i % 3 == g] for g in range(3)}
    assert got == {g: pytest.approx((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, abs=1e-15) for g, v in values.items()}
    assert seen.value == 1000 and not glob.glob(f"{shared_dir(spark).removeprefix('file:')}/percentiles-*")


def test_minimal_keys(spark):
    rng = random.Random(1)
    rows = [(i % 40, i // 40, i % 7 if i % 3 else None, rng.randint(0, 10**6), "same", None) for i in range(800)]
    rows[5] = (*rows[5][:3], rows[6][3], *rows[5][4:])
    cols = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e string, f int")

    def is_key(s):
        return len({tuple(r[i] for i in s) for r in rows}) == len(rows)

    every = [s for k in range(1, 7) for s in combinations(range(6), k) if is_key(s)]
    want = {tuple(cols[i] for i in s) for s in every if not any(set(t) < set(s) for t in every)}
    got = Q.minimal_keys(df, cols).collect()
    assert {tuple(r.key_columns) for r in got} == want and ("a", "b") in want and all(r.size == len(r.key_columns) for r in got)
    assert {tuple(r.key_columns) for r in Q.minimal_keys(df, cols, largest=1).collect()} == {s for s in want if len(s) == 1}
    assert Q.minimal_keys(df.union(df), cols).count() == 0
    assert [r.key_columns for r in Q.minimal_keys(df.limit(1), cols).collect()] == [[]]


@pytest.mark.parametrize("shares", [1, 32])
def test_minimal_keys_with_colliding_hashes(spark, monkeypatch, shares):
    """Equal hashes of different values make no repeated key, however many there are; a single repeated value is found."""
    monkeypatch.setattr(Q, "SHARES", shares)
    df = spark.range(3000).selectExpr("id AS a", "id % 50 AS b", "if(id = 7, 8, id) AS c", "id div 50 AS d")
    assert {tuple(r.key_columns) for r in Q.minimal_keys(df, ["a", "b", "c", "d"]).collect()} == {("a",), ("b", "c"), ("b", "d")}
    monkeypatch.setattr(Q.F, "xxhash64", lambda *cols: F.expr("a % 1000"))
    sets = [(0,), (2,), (1, 3)]
    rows = df.select("a", "b", "c", "d")
    assert Q._repeated_sets(rows, ["a", "b", "c", "d"], sets, 3000, 1) == {(2,)}


def test_minimal_keys_shuffle_hashes_only(spark, monkeypatch):
    """What is shuffled per row and candidate is one long, not the columns."""
    plans = []
    plain = type(spark.range(1)).collect

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(type(spark.range(1)), "collect", noted)
    df = spark.range(500).selectExpr("id AS a", "repeat('wide', 50) || id AS b")
    assert {tuple(r.key_columns) for r in Q.minimal_keys(df, ["a", "b"]).collect()} == {("a",), ("b",)}
    assert any("hashpartitioning(h#" in p for p in plans) and not any("hashpartitioning(b#" in p for p in plans)


def test_ranges_follow_the_size_of_the_rows(spark, skewed, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_BYTES", 1 << 15)
    df = skewed.select("g", "id", "v")
    n = ordering._ranges(df)
    assert n == -(-20000 * ordering._row_bytes(df) // (1 << 15)) and n > 20
    placed = ordering.with_position(df, ["g"], [F.col("v").desc(), F.col("id")])
    want = df.selectExpr("id", "row_number() over (partition by g order by v desc, id) as w")
    assert placed.join(want, "id").filter("position <> w").count() == 0
    monkeypatch.setattr(ordering, "RANGE_BYTES", 1 << 40)
    assert ordering._ranges(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))
