"""CSV with line breaks inside quotes against one reader."""

import csv
import random

import pytest

from panelwright.sources.tables import quoted_records, read_quoted_csv


def write(path, rows, ending="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=ending)
        writer.writerows(rows)


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    for name, value in zip(names, ("1024", "1", "64"), strict=True):
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_breaks_over_splits_equal_one_reader(spark, tmp_path, small_splits, ending):
    rng = random.Random(4)
    pieces = ["plain", 'a "word"', "two\nlines", "\n\n", ",", '"', "é\n中", "x" * 300, "end\n" * 40, '""\n""']
    want = []
    for f in range(3):
        rows = [["id", "note", "n"]] + [[str(i), "".join(rng.choices(pieces, k=rng.randint(1, 4))), str(i * f)] for i in range(200)]
        write(tmp_path / f"part{f}.csv", rows, ending)
        want += [(*r, f"part{f}.csv", i + 2) for i, r in enumerate(rows[1:])]
    df = read_quoted_csv(spark, str(tmp_path))
    assert df.columns == ["id", "note", "n", "_source_file", "_source_row"]
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 30
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_headers_must_agree(spark, tmp_path):
    write(tmp_path / "a.csv", [["a", "b"], ["1", "2"]])
    write(tmp_path / "b.csv", [["a", "c"], ["1", "2"]])
    with pytest.raises(ValueError, match="different headers"):
        read_quoted_csv(spark, str(tmp_path))


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_lines_stay_in_their_split(spark, tmp_path, small_splits, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = [["id", "note"], ["1", "\n" * 5000], ["2", ""], *[[str(i), "a\nb" * (i % 3)] for i in range(3, 300)], ["300", "x"]]
        write(tmp_path / "a.csv", rows)
        with open(tmp_path / "a.csv", "a", newline="") as out:
            out.write('\n\n301,"left\nopen')
        records = quoted_records(spark, str(tmp_path))
        found = {r["_record"]: r["_text"] for r in records.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = [next(csv.reader([t])) if "\n" not in t else next(csv.reader(t.splitlines(True))) for n, t in sorted(found.items())]
    assert sorted(found) == list(range(1, 303)) and texts[:-1] == rows and texts[-1] == ["301", "left\nopen"]
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [count_if" not in plan and "_line" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)
    assert not any("_line" in x and "Window" in x for x in plan.splitlines()) and "sum(_quotes" not in plan
