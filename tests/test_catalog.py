import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tripscope.operators import metrics as M

BASE = dict(id="x", label="X", source="trips", formula="avg(v){f}", coverage="count(v){f}", direction="higher_is_better", unit="rate", min_sample=2, grains=["global", "office"])


@pytest.mark.parametrize("change,word", [
    (dict(grains=["office"]), "global"), (dict(grains=["global", "office; drop"]), "identifier"), (dict(segment_by="office", valid_segments=["a"]), "guard"), (dict(segment_by="regime"), "together"),
    (dict(direction="sideways"), "direction"), (dict(min_sample=0), "min_sample"), (dict(formula=" "), "formula"), (dict(surprise=1), "unknown metric keys"), (dict(id="a b"), "identifier")])
def test_bad_definitions_are_refused(change, word):
    with pytest.raises(ValueError, match=word):
        M.spec_from_dict({**BASE, **change})


def test_duplicate_ids_are_refused():
    with pytest.raises(ValueError, match="duplicate"):
        M.catalog([M.spec_from_dict(BASE), M.spec_from_dict(BASE)])


def test_default_catalog_has_nine_metrics():
    assert len(M.DEFAULT_CATALOG) == 9 and M.DEFAULT_CATALOG["cost_per_km"].sla_target == 85.0


def frame(spark):
    rows = [("2026-05-01", "a", 1.0, "R"), ("2026-05-01", "a", 0.0, "R"), ("2026-05-01", None, 1.0, "R"), ("2026-05-01", "b", None, "R"), ("2026-05-01", "b", 1.0, "OTHER"), (None, "a", 1.0, "R")]
    return spark.createDataFrame(rows, "m string, office string, v double, regime string").withColumn("month", F.to_date("m"))


def test_one_pass_slices(spark):
    spec = M.spec_from_dict({**BASE, "segment_by": "regime", "valid_segments": ["R"]})
    got = {(r.grain, r.entity): r for r in M.slices({"trips": frame(spark)}, {"x": spec}).collect()}
    assert set(got) == {("global", "ALL"), ("office", "a"), ("office", "b"), ("office", "NA")}
    assert got["global", "ALL"].n == 4 and got["global", "ALL"].value == pytest.approx(2 / 3) and got["global", "ALL"].coverage == 0.75
    assert got["office", "a"].value == 0.5 and got["office", "NA"].value is None and got["office", "NA"].n == 1
    assert got["office", "b"].n == 1 and got["office", "b"].covered == 0


def test_segment_values_are_quoted():
    spec = M.spec_from_dict({**BASE, "segment_by": "regime", "valid_segments": ["it's"]})
    assert "'it''s'" in spec.compiled("avg(v){f:v > 0}") and "(v > 0)" in spec.compiled("avg(v){f:v > 0}")


@pytest.mark.parametrize("text,want", [("2026-06", dt.date(2026, 6, 1)), ("2026-06-17", dt.date(2026, 6, 1)), (" 2026-06 ", dt.date(2026, 6, 1)), ("June", None), ("2026-13", None), ("", None), (None, None)])
def test_periods(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(M.parse_period(F.col("t")).alias("p"), M.previous(M.parse_period(F.col("t"))).alias("q")).first()
    assert got.p == want and (want is None or got.q == dt.date(2026, 5, 1))


def test_history_leaves_gated_months_out(spark, slices_of):
    rows = [("ota", "global", "ALL", f"2026-0{i}-01", v, 900) for i, v in ((1, 0.1), (2, None), (3, 0.3), (4, 0.4))]
    got = {str(r.period): r.history for r in M.history(slices_of(rows), 2).collect()}
    assert got == {"2026-01-01": [0.1], "2026-03-01": [0.1, 0.3], "2026-04-01": [0.3, 0.4]}


def test_unknown_slice_is_empty(spark, slices_of):
    s = slices_of([("ota", "global", "ALL", "2026-05-01", 0.9, 900)])
    asked = s.select("metric_id", F.lit("nowhere").alias("grain"), "entity", "period")
    got = M.measure(s, asked).first()
    assert got.n == 0 and got.value is None and got.coverage == 0.0


def test_quality_labels(spark, slices_of):
    spec = {"ota": M.DEFAULT_CATALOG["ota"]}
    rows = [("ota", "office", e, "2026-05-01", v, n) for e, v, n in (("small", None, 10), ("broken", None, 900), ("high", 0.9, 2000), ("medium", 0.9, 1999))]
    got = {r.entity: (r.confidence, len(r.caveats)) for r in slices_of(rows).withColumns(M.quality(spec)).collect()}
    assert got == {"small": ("insufficient_sample", 1), "broken": ("not_computable", 1), "high": ("HIGH", 0), "medium": ("MEDIUM", 0)}
    low = slices_of(rows[2:3], coverage=0.5).withColumns(M.quality(spec)).first()
    assert low.confidence == "LOW"


def test_definitions_are_loaded_from_a_location(spark, tmp_path):
    import json

    specs = list(M.DEFAULT_CATALOG.values())
    for s in specs[:3]:
        (tmp_path / f"{s.id}.json").write_text(json.dumps(M.spec_to_dict(s), indent=1))
    (tmp_path / "more.json").write_text(json.dumps([M.spec_to_dict(s) for s in specs[3:]]))
    assert M.load_catalog(spark, str(tmp_path)) == M.DEFAULT_CATALOG
    (tmp_path / "again.json").write_text(json.dumps(M.spec_to_dict(specs[0])))
    with pytest.raises(ValueError, match="duplicate metric ota"):
        M.load_catalog(spark, str(tmp_path))
    (tmp_path / "again.json").write_text("{")
    with pytest.raises(ValueError, match="again.json"):
        M.load_catalog(spark, str(tmp_path))


@pytest.mark.parametrize("files", [1, 2])
def test_several_definitions_in_a_file(spark, tmp_path, files):
    texts = [(json.dumps(M.spec_to_dict(s)),) for s in M.DEFAULT_CATALOG.values()]
    spark.createDataFrame(texts, "value string").coalesce(files).write.text(str(tmp_path / "lines"))
    loaded = M.load_catalog(spark, str(tmp_path / "lines"))
    assert loaded == M.DEFAULT_CATALOG
    for text in ("{} rest", " \n"):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError, match="bad.json"):
            M.load_catalog(spark, str(tmp_path / "bad.json"))
