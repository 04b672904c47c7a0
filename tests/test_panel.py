"""Cleaning, joins, features, targets and splits on hand-made rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelwright.functions.windows import PanelSpec
from panelwright.operators import clean, contracts, enrich, features, sequences, splits

from .conftest import at

SPEC = PanelSpec()


def test_grid_and_causal_fill_with_lineage(spark):
    rows = [
        ("r", at("01 00:00"), 2, 100, 100, 200), ("r", at("01 00:30"), 3, None, 110, 200), ("r", at("01 01:30"), 5, 130, 130, 200),
    ]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, row_id long, volume long, vehicles long, capacity long")
    start, end = F.lit(at("01 00:00")).cast("timestamp_ntz"), F.lit(at("01 01:30")).cast("timestamp_ntz")
    grid = clean.complete_grid(df, SPEC, ["capacity"], start, end)
    out = clean.causal_fill(grid, SPEC, "volume", same_row="vehicles", lag_steps=2, forward_limit=1).orderBy("ts").collect()
    assert [r["inserted"] for r in out] == [False, False, True, False]
    assert [r["volume"] for r in out] == [100, 110, 100, 130]
    assert [r["volume_method"] for r in out] == ["observed", "same_row_vehicles", clean.PREVIOUS, "observed"]
    assert [r["volume_donor_row"] for r in out] == [None, 3, 2, None]
    assert [r["volume_donor_rows"] for r in out] == [None, "[3]", "[2]", None]
    assert [r["capacity"] for r in out] == [200] * 4


def test_previous_period_does_not_chain_but_forward_sees_it(spark):
    rows = [("r", at(f"01 {h:02d}:{m}"), i, v) for i, (h, m, v) in enumerate([(0, "00", 7), (0, "30", None), (1, "00", None), (1, "30", None), (2, "00", None)])]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, row_id long, x long")
    out = clean.causal_fill(df, SPEC, "x", lag_steps=2, forward_limit=1).orderBy("ts").collect()
    assert [r["x_method"] for r in out] == ["observed", clean.FORWARD, clean.PREVIOUS, clean.FORWARD, "unresolved"]
    with pytest.raises(ValueError):
        clean.require_filled(spark.createDataFrame([(r["entity"], r["ts"], r["x"]) for r in out], "entity string, ts timestamp_ntz, x long"), SPEC, ["x"])


def test_peer_median_only_fills_leading_gaps(spark):
    rows = [("a", at("01 00:00"), 1, 10.0), ("b", at("01 00:00"), 2, 30.0), ("c", at("01 00:00"), None, None)]
    df = spark.createDataFrame([(*r, "g") for r in rows], "entity string, ts timestamp_ntz, row_id long, x double, grp string")
    out = {r["entity"]: r for r in clean.causal_fill(df, SPEC, "x", peers="grp").collect()}
    assert out["c"]["x"] == 20.0 and out["c"]["x_method"] == clean.PEERS and out["c"]["x_donor_rows"] == "[1,2]"


def test_class_bands(spark):
    df = spark.createDataFrame([(v,) for v in (49, 50, 80, 100)], "v int")
    got = [r[0] for r in df.orderBy("v").select(clean.capacity_band(F.col("v"), F.lit(200))).collect()]
    assert got == ["Free-flow", "Moderate", "Heavy", "Severe"]


def test_hourly_cleaning(spark):
    rows = [("s", at(f"01 0{i}:00"), i + 2, t, v, c) for i, (t, v, c) in enumerate(
        [(20.0, 1000.0, "Clear"), (None, 900.0, " rain "), (None, None, "RAIN"), (30.0, 800.0, "foggy")])]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, row long, temperature double, visibility double, label string")
    spec = PanelSpec(cadence_minutes=60)
    out = clean.forward_fill(clean.forward_fill(df, spec, "temperature", 2, "row"), spec, "visibility", 2, "row")
    out = clean.canonical_labels(out, "label", clean.CONDITION_MAP).orderBy("ts").collect()
    assert [r["label"] for r in out] == ["Clear", "Rain", "Rain", "Fog"]
    assert [r["temperature"] for r in out] == [20.0, 20.0, 20.0, 30.0]
    assert [r["temperature_from_row"] for r in out] == [None, 2, 2, None]
    assert [r["visibility_from_row"] for r in out] == [None, None, 3, None]
    odd = clean.canonical_labels(df.withColumn("label", F.lit("hail")), "label", clean.CONDITION_MAP)
    assert clean.unknown_labels(odd, "label").count() == 1
    broken = df.filter("row != 4")
    assert contracts.cadence_breaks(broken, spec).count() == 1 and contracts.cadence_breaks(df, spec).count() == 0


def test_join_repeats_context_and_reports_misses(spark):
    facts = spark.createDataFrame([("r", "s", at("01 00:00")), ("r", "s", at("01 00:30"))], "entity string, grp string, ts timestamp_ntz")
    hourly = spark.createDataFrame([("s", at("01 00:00"), 21.0)], "grp string, hour timestamp_ntz, temperature double")
    out = enrich.join_hourly(facts, hourly, "grp", "ts")
    assert [(r["temperature"], r["hourly_join_status"]) for r in out.collect()] == [(21.0, "both")] * 2
    missed = enrich.join_hourly(facts.withColumn("grp", F.lit("z")), hourly, "grp", "ts")
    with pytest.raises(ValueError, match="2 unexpected misses"):
        enrich.require_matched(missed, "hourly_join_status")
    with pytest.raises(ValueError):
        contracts.require_unique(hourly.unionByName(hourly), ["grp", "hour"])


def feature_panel(spark, change=None):
    start = datetime(2025, 1, 6)
    rows = []
    for e, base in (("A", 0), ("B", 1000)):
        for i in range(160):
            volume = float(base + i + 1)
            if change and e == "A" and i >= change:
                volume = -1.0
            rows.append((e, start + timedelta(minutes=30 * i), volume, volume / 10 + 20))
    return spark.createDataFrame(rows, "entity string, ts timestamp_ntz, load double, speed double")


def test_lags_stay_inside_the_entity_and_ignore_the_future(spark):
    plan = features.FeaturePlan()
    spec = PanelSpec(chunk_steps=50)
    out = features.add_history(feature_panel(spark), spec, plan)
    b = out.filter("entity = 'B'").orderBy("ts").collect()
    assert b[0]["load_lag_1"] is None and b[1]["load_lag_1"] == 1001.0 and b[48]["load_lag_48"] == 1001.0
    assert b[3]["load_rolling_mean_4"] is None and b[4]["load_rolling_mean_4"] == pytest.approx(1002.5)
    assert b[4]["load_rolling_std_4"] == pytest.approx(1.2909944487)
    assert sum(not r["history_available"] for r in b) == 48
    early = lambda df: df.filter(F.col("ts") <= F.lit(datetime(2025, 1, 6) + timedelta(minutes=30 * 99)).cast("timestamp_ntz"))
    mutated = features.add_history(feature_panel(spark, change=100), spec, plan)
    assert early(out).exceptAll(early(mutated)).count() == 0


def test_peaks_bands_and_event_distance(spark):
    plan = features.FeaturePlan()
    times = ["06 06:30", "06 07:00", "06 09:30", "06 10:00", "06 17:00", "06 19:30", "06 20:00"]
    df = spark.createDataFrame([(at(t),) for t in times], "ts timestamp_ntz").withColumns(features.peak_columns(F.col("ts"), plan))
    rows = df.orderBy("ts").collect()
    assert [r["is_morning_peak"] for r in rows] == [False, True, True, False, False, False, False]
    assert [r["is_evening_peak"] for r in rows] == [False, False, False, False, True, True, False]
    bands = spark.createDataFrame([(v,) for v in (14.9, 15.0, 25.0, None)], "t double")
    assert [r[0] for r in bands.select(features.banded(F.col("t"), plan.temperature_bounds, plan.temperature_labels)).collect()] == ["cool", "mild", "warm", None]
    days = spark.createDataFrame([(f"2025-01-{d:02d}", int(d in (3, 10))) for d in range(1, 13)], "d string, e int").withColumn("d", F.to_date("d"))
    got = {r["d"].day: r["days_to_nearest_event"] for r in enrich.nearest_event_days(days, "d", F.col("e") == 1).collect()}
    assert got == {d: min(abs(d - 3), abs(d - 10)) for d in range(1, 13)}


def test_targets_keep_origins_and_unknown_stays_null(spark):
    start, seen = datetime(2025, 1, 1), [True, False] + [True] * 6
    rows = [(e, start + timedelta(minutes=30 * i), float(i + b), x, seen[i]) for e, b in (("A", 0), ("B", 100)) for i, x in enumerate([0, None, 1, 0, 0, 2, 0, 0])]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, load double, events long, observed boolean")
    targets = (("load", "load", "regression", None), ("event", "events", "binary", "observed"))
    out = features.add_targets(df, SPEC, targets, (1, 2))
    a = out.filter("entity = 'A'").orderBy("ts").collect()
    assert [r["target_load_h2"] for r in a] == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, None, None]
    assert [r["target_event_h1"] for r in a] == [None, True, False, False, True, False, False, None]
    assert out.filter("NOT target_load_h2_available").count() == 4
    assert features.misplaced_targets(out, SPEC, (1, 2)).agg(F.sum("misplaced_rows")).first()[0] == 0


def test_largest_remainder_and_boundaries(spark):
    df = spark.createDataFrame([(at("01 00:00") + timedelta(minutes=30 * i),) for i in range(11)], "ts timestamp_ntz")
    rows = {r["split"]: r["timestamps"] for r in splits.partition_bounds(df, "ts").collect()}
    assert rows == {"train": 8, "validation": 2, "test": 1}
    for n in (1, 7, 20, 999):
        parts = spark.range(1).select(*[x.alias(str(i)) for i, x in enumerate(splits.largest_remainder(F.lit(n), (0.7, 0.15, 0.15)))]).first()
        assert sum(parts) == n


def test_evenly_spaced_budget_keeps_ends(spark):
    stamps = [at("01 00:00") + timedelta(minutes=30 * i) for i in range(10)]
    df = spark.createDataFrame([(e, t) for e in "AB" for t in stamps], "entity string, ts timestamp_ntz")
    out = splits.evenly_spaced(df, "ts", 4)
    assert sorted({r["ts"] for r in out.collect()}) == [stamps[i] for i in (0, 3, 6, 9)] and out.count() == 8
    assert splits.evenly_spaced(df, "ts", 20).count() == 20


def test_runs_reset_at_gaps_and_partitions(spark):
    stamps = [0, 1, 2, 4, 5, 6, 7]
    rows = [("A", at("01 00:00") + timedelta(minutes=30 * i), "train" if i < 6 else "test") for i in stamps]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, split string")
    spec = PanelSpec(chunk_steps=3)
    runs = [r["run_length"] for r in sequences.run_lengths(df, spec).orderBy("ts").collect()]
    assert runs == [1, 2, 3, 1, 2, 3, 4]
    inside = [r["run_length"] for r in sequences.run_lengths(df, spec, ["split"]).orderBy("ts").collect()]
    assert inside == [1, 2, 3, 1, 2, 1, 2]
    origins = sequences.eligible_origins(df, spec, 2).orderBy("ts").collect()
    assert len(origins) == 5


def test_grid_refuses_bad_panels(spark):


    spec = PanelSpec(entity="entity", ts="ts", cadence_minutes=30)
    rows = [("a", at("01 00:00"), "x", 1), ("a", at("01 00:30"), "y", 2), ("b", at("01 00:00"), "z", 3), ("b", at("01 00:00"), "z", 4)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, grp string, v int")
    found = {(r["problem"], r["entity"], r["n"]) for r in clean.grid_problems(df, spec, ["grp"], 3).collect()}
    assert found == {("repeated_key", "b", 1), ("conflicting_grp", "a", 2), ("entity_count", None, 2)}
    bounds = clean.day_bounds(df, spec)
    with pytest.raises(ValueError, match="repeated_key"):
        clean.complete_grid(df, spec, ["grp"], **bounds, strict=True)
    grid = clean.complete_grid(df.dropDuplicates(["entity", "ts"]), spec, ["grp"], **bounds)
    assert {(r["entity"], r["grp"]) for r in grid.collect()} == {("a", "x"), ("b", "z")}
