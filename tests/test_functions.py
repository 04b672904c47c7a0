"""Chunked windows, exact ranks and hot-key joins against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.keyed import attach_by_key
from panelwright.functions.order_stats import ordered_index, prefix_sums, quantiles, value_bin
from panelwright.functions.windows import PanelSpec, last_known_marker, over_chunks
from panelwright.sources.tables import significant_text, version_path

START = datetime(2024, 3, 1)
SCHEMA = "entity string, ts timestamp_ntz, x double"


def panel(spark, entities=3, steps=150, seed=1, gaps=0.2):
    rng = np.random.default_rng(seed)
    rows = [
        (f"e{e}", START + timedelta(minutes=30 * i), None if rng.random() < gaps else float(rng.integers(0, 50)))
        for e in range(entities)
        for i in range(steps)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def build(w):
    frame = w.rowsBetween(-4, -1)
    return {
        "lag": F.lag("x", 5).over(w),
        "lead": F.lead("x", 3).over(w),
        "mean": F.when(F.count("x").over(frame) == 4, F.avg("x").over(frame)),
        "fill": F.last("x", ignorenulls=True).over(w.rowsBetween(-2, 0)),
    }


@pytest.mark.parametrize("chunk", [7, 13, 48, 1344])
def test_chunked_windows_equal_entity_windows(spark, chunk):
    df = panel(spark)
    spec = PanelSpec(chunk_steps=chunk)
    got = over_chunks(df, spec, build, back=5, ahead=3)
    want = over_chunks(df, spec.plain(), build)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_stacked_windows_share_the_halo(spark):
    df = panel(spark, gaps=0.5)

    def first(w):
        return {"a": F.coalesce("x", F.lag("x", 6).over(w))}

    def second(w):
        return {"b": F.last("a", ignorenulls=True).over(w.rowsBetween(-2, 0))}

    got = over_chunks(df, PanelSpec(chunk_steps=10), first, second, back=8)
    want = over_chunks(df, PanelSpec(chunk_steps=None), first, second)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_marker_is_carried_over_chunks(spark):
    df = panel(spark, gaps=0.9)
    got = last_known_marker(df, PanelSpec(chunk_steps=9), F.when(F.col("x").isNotNull(), F.col("ts")), "m")
    w = Window.partitionBy("entity").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("m", F.max(F.when(F.col("x").isNotNull(), F.col("ts"))).over(w))
    assert got.select(*want.columns).exceptAll(want).count() == 0


def test_value_bin_is_monotone(spark):
    values = sorted([-1e9, -3.0, -2.9999, -1e-12, 0.0, 5e-324, 1e-12, 0.5, 1.0, 1.0000001, 2.0, 1e300])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_bin(F.col("v")).alias("b"))
    bins = [r["b"] for r in df.orderBy("v").collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("bounded", [False, True])
def test_quantiles_match_numpy(spark, bounded):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(0, 10, 501)] + [("b", float(v)) for v in rng.integers(0, 4, 200)] + [("c", 7.0)]
    probs = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    got = {r["g"]: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs, bounded).collect()}
    for g in "abc":
        mine = [v for k, v in rows if k == g]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(mine, p), abs=1e-9)


def test_prefix_sums_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [("g", float(round(v, 1)), int(y)) for v, y in zip(rng.normal(0, 3, 400), rng.integers(0, 2, 400))]
    table = prefix_sums(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", {"pos": F.col("y")})
    for r in table.collect():
        assert r["before_pos"] == sum(y for _, s, y in rows if s < r["s"])
        assert r["pos"] == sum(y for _, s, y in rows if s == r["s"])
        assert r["total_pos"] == sum(y for *_, y in rows)


def test_ordered_index_ranks_distinct_timestamps(spark):
    df = panel(spark, entities=2, steps=100)
    rows = ordered_index(df, "ts").orderBy("ts").collect()
    assert [r["rank"] for r in rows] == list(range(100)) and {r["total"] for r in rows} == {100}


def test_attach_by_key_handles_hot_and_null_keys(spark):
    left = [(i, "hot" if i % 3 else f"k{i}") for i in range(600)] + [(1000, None)]
    df = spark.createDataFrame(left, "id long, k string")
    right = df.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = attach_by_key(df, right, ["k"], "n")
    want = df.join(right, "k", "left").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 601


def test_significant_text(spark):
    values = [0.0, 1.0, -2.5, 1 / 3, 123456.789, 1e-4, 2e15, 1e-7]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", significant_text(F.col("v")).alias("t")).collect():
        assert float(r["t"]) == pytest.approx(float("%.12g" % r["v"]), rel=1e-12)
    assert df.filter("v = 1.0").select(significant_text(F.col("v"))).first()[0] == "1"


@pytest.mark.parametrize("bad", ["../up", "a/b", "", ".hidden", "a..b"])
def test_version_paths_are_safe(bad):
    with pytest.raises(ValueError):
        version_path("/tmp/x", bad, "t")


def test_quantiles_with_nan_and_infinities(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", v) for v in (5.0, 6.0, 7.0, nan, None)] + [("b", v) for v in (-inf, 1.0, inf)] + [("c", inf), ("c", inf), ("d", nan)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["m"] for r in quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 6.0, "b": 1.0, "c": inf}


def test_calibration_keeps_order(spark):
    from panelwright.operators.models import fit_sigmoid

    rows = [([1 - p / 40, p / 40], float(p > 18 + (p % 5))) for p in range(1, 40)]
    df = spark.createDataFrame(rows, "scores array<double>, label double")
    out = fit_sigmoid(df, "scores", "label", 2).transform(df, "scores").collect()
    positive = [r["probabilities"][1] for r in sorted(out, key=lambda r: r["scores"][1])]
    assert positive == sorted(positive) and positive[0] < 0.5 < positive[-1]


def test_close_large_values_fill_no_bin(spark, monkeypatch):
    """Values far from zero and close together: a bin is split until it is small, and ranks stay exact."""
    from panelwright.functions import order_stats

    monkeypatch.setattr(order_stats, "BIN_VALUES", 500)
    n = 40_000
    df = spark.range(n).select((F.col("id") % 2).cast("string").alias("g"), (F.lit(1.7e9) + (F.col("id") * 7919 % n) / 8).alias("v"))
    wanted = {"low": 0.013, "mid": 0.5, "high": 0.997}
    pandas = df.toPandas()
    for groups, bounded in (([], True), (["g"], True), (["g"], False)):
        got = order_stats.quantiles(df, groups, "v", wanted, bounded)
        for row in got.collect():
            mine = pandas if not groups else pandas[pandas["g"] == row["g"]]
            assert [row[k] for k in wanted] == pytest.approx([mine["v"].quantile(p) for p in wanted.values()], rel=1e-15)
    distinct, _ = order_stats._binned(df, ["g"], "v", {"rows": F.lit(1)})
    assert distinct.groupBy("g", "_bin").count().agg(F.max("count")).first()[0] <= 500


def test_ranges_rank_a_day_of_many_times(spark, monkeypatch):
    from panelwright.functions import ranges

    monkeypatch.setattr(ranges, "RANGE_ROWS", 2_000)
    times = spark.range(20_000).select((F.lit(datetime(2024, 5, 1)) + F.make_dt_interval(secs=(F.col("id") * 7 % 20_000) / 1000)).cast("timestamp_ntz").alias("ts"))
    got = ordered_index(times.unionByName(times.limit(50)), "ts")
    assert got.rdd.getNumPartitions() == 10
    assert max(got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 4_000
    rows = got.orderBy("ts").collect()
    assert [r["rank"] for r in rows] == list(range(20_000)) and {r["total"] for r in rows} == {20_000}
    assert ordered_index(times.limit(0), "ts").count() == 0
