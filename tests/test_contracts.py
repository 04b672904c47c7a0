"""Contract rules, quarantine and duplicate retention on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import contracts as c

LABELS = ("Free-flow", "Moderate", "Heavy", "Severe")
FACTS = c.Contract(
    dataset="facts",
    columns=("entity", "name", "date", "time", "volume", "speed", "occupancy", "mix", "level"),
    clock=c.Clock("date", r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd", "ts", "time", r"\d{2}:\d{2}", "HH:mm", 30),
    key=("entity", "ts"),
    texts=(c.Text("name"),),
    categories=(
        c.Category("entity", allowed=("A", "B")),
        c.Category("level", allowed=LABELS, nullable=True, report_missing=True, disposition=c.CELL),
    ),
    numbers=(
        c.Number("volume", integer=True, nullable=True, report_missing=True, minimum=0, minimum_reason="negative_traffic_volume"),
        c.Number("speed", nullable=True, report_missing=True, minimum=0, maximum=200, maximum_reason="excessive_speed"),
        c.Number("occupancy", nullable=True, report_missing=True, minimum=0, maximum=100, minimum_reason="invalid_occupancy", maximum_reason="invalid_occupancy"),
    ),
    shares=(c.Shares("mix", ("2W", "Car")),),
)
GOOD = dict(entity="A", name="x", date="2025-01-01", time="00:30", volume="10", speed="50.5", occupancy="20", mix='{"2W": 0.5, "Car": 0.5}', level="Heavy")


def frame(spark, *changes):
    rows = [{**GOOD, "time": f"{i:02d}:30", **x, "source_row": i + 2, "source_file": "f.csv"} for i, x in enumerate(changes)]
    names = [*FACTS.columns, "source_row", "source_file"]
    schema = ", ".join(f"{n} {'long' if n == 'source_row' else 'string'}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def found(result):
    return sorted((r["source_row"], r["field"], r["reason_code"], r["disposition"]) for r in result.issues.collect())


def test_valid_row_has_no_issue(spark):
    result = c.validate(frame(spark, {}), FACTS)
    assert found(result) == [] and result.rejected.count() == 0
    row = result.valid.first()
    assert row["volume"] == 10 and row["speed"] == 50.5 and row["validation_status"] == "valid"
    assert row["ts"].isoformat() == "2025-01-01T00:30:00"


def test_boundary_values_are_allowed(spark):
    result = c.validate(frame(spark, dict(volume="0", speed="200", occupancy="100"), dict(speed="0", occupancy="0")), FACTS)
    assert found(result) == []


@pytest.mark.parametrize(
    "change, issue",
    [
        (dict(volume="-1"), ("volume", "negative_traffic_volume", c.CELL)),
        (dict(volume="1.5"), ("volume", "invalid_type", c.CELL)),
        (dict(volume=" "), ("volume", "missing_value", c.CELL)),
        (dict(speed="201"), ("speed", "excessive_speed", c.CELL)),
        (dict(speed="inf"), ("speed", "invalid_type", c.CELL)),
        (dict(speed="NaN"), ("speed", "invalid_type", c.CELL)),
        (dict(speed="5d"), ("speed", "invalid_type", c.CELL)),
        (dict(occupancy="101"), ("occupancy", "invalid_occupancy", c.CELL)),
        (dict(level=""), ("level", "missing_value", c.CELL)),
        (dict(level="heavy"), ("level", "invalid_category", c.CELL)),
        (dict(mix="[]"), ("mix", "invalid_json", c.CELL)),
        (dict(mix='{"2W": true, "Car": 0.5}'), ("mix", "invalid_json", c.CELL)),
        (dict(mix='{"2W": 0.5, "Car": 0.4}'), ("mix", "invalid_json", c.CELL)),
        (dict(mix='{"2W": 0.5, "Car": 0.5, "Bus": 0}'), ("mix", "invalid_json", c.CELL)),
        (dict(time="00:15"), ("time", "invalid_timestamp", c.ROW)),
        (dict(time="0:30"), ("time", "invalid_timestamp", c.ROW)),
        (dict(date="2025-02-30"), ("time", "invalid_timestamp", c.ROW)),
        (dict(name=None), ("name", "missing_value", c.ROW)),
        (dict(entity=""), ("entity", "missing_key", c.ROW)),
        (dict(entity="C"), ("entity", "invalid_category", c.ROW)),
    ],
)
def test_each_rule(spark, change, issue):
    result = c.validate(frame(spark, change), FACTS)
    assert found(result) == [(2, *issue)]
    rejected = issue[2] == c.ROW
    assert result.rejected.count() == int(rejected)
    if rejected:
        assert result.rejected.first()["rejection_reason"] == issue[1]
    else:
        row = result.valid.first()
        assert row["validation_status"] == "valid_with_issues" and row[issue[0]] is None


def test_schema_difference_rejects_the_dataset(spark):
    df = frame(spark, {}, {}).drop("speed").withColumn("other", F.lit(1))
    result = c.validate(df, FACTS)
    assert result.valid.count() == 0 and result.rejected.count() == 2
    assert sorted((r["field"], r["reason_code"], r["disposition"]) for r in result.issues.collect()) == [
        ("other", "unexpected_column", c.DATASET), ("speed", "missing_required_column", c.DATASET),
    ]
    assert result.rejected.first()["rejection_reason"] == "missing_required_column|unexpected_column"


def test_most_complete_duplicate_wins_then_lowest_row(spark):
    same = dict(time="00:30")
    df = frame(spark, {**same, "speed": "999"}, same, same, {**same, "entity": "B"})
    result = c.validate(df, FACTS)
    lost = {r["source_row"]: (r["retained_source_row"], r["message"]) for r in result.issues.filter("reason_code = 'duplicate_key'").collect()}
    assert lost == {
        2: (3, "Duplicate key removed; exact_duplicate=false"), 4: (3, "Duplicate key removed; exact_duplicate=true"),
    }
    assert sorted(r["source_row"] for r in result.valid.collect()) == [3, 5]
    book = c.row_accounting(result.annotated, "facts").first()
    assert (book["input_rows"], book["valid_rows"], book["rejected_rows"], book["accounted"]) == (4, 2, 2, True)


def test_rejected_rows_keep_raw_values_and_ledger_json(spark):
    result = c.validate(frame(spark, dict(time="00:15", volume="-1")), FACTS)
    row = result.rejected.first()
    assert row["volume"] == "-1" and row["rejection_reason"] == "invalid_timestamp"
    assert {r["field"]: r["rejected_value"] for r in result.issues.collect()} == {"time": '"00:15"', "volume": '"-1"'}


def test_flag_and_name_must_agree(spark):
    daily = c.Contract(
        "daily", ("date", "flag", "name"), c.Clock("date", r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd", "day"), ("day",),
        numbers=(c.Number("flag", integer=True, disposition=c.ROW, invalid_reason="invalid_flag", allowed=(0, 1)),),
        flag_names=(("flag", "name"),),
    )
    rows = [("2025-01-01", "1", "Fair"), ("2025-01-02", "1", " "), ("2025-01-03", "0", "Fair"), ("2025-01-04", "2", None)]
    df = spark.createDataFrame([(*r, i + 2, "d.csv") for i, r in enumerate(rows)], "date string, flag string, name string, source_row long, source_file string")
    assert [x[2] for x in found(c.validate(df, daily))] == ["missing_flag_name", "unexpected_flag_name", "invalid_flag"]


def test_detects_contract_and_zone(spark):
    assert c.detect(FACTS.columns, [FACTS]) is FACTS and c.detect(["a"], [FACTS]) is None
    zoned = c.Clock("date", r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd", "ts", "time", r"\d{2}:\d{2}", "HH:mm", 30, "Asia/Kolkata")
    out = frame(spark, {}).select(c.clock_value(zoned).cast("string").alias("t")).first()
    assert out["t"] == "2024-12-31 19:00:00"
