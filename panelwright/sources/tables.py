"""Reading and writing tables: CSV with row lineage, Parquet, JSON records."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keyed import stored

_VERSION = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Headered CSV as text plus ``_source_file`` and ``_source_row`` (first data row = 2).

    Row numbers come from each split's own row ids plus the row counts of the file's earlier
    splits, so files are read in parallel and the number does not depend on the splitting.
    """
    reader = spark.read.option("header", True)
    frame = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    located = frame.select(
        *frame.columns,
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_name").alias("_source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    blocks = located.groupBy("_path", "_block").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "_path", "_block", (F.lit(2) + F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return located.join(blocks, ["_path", "_block"]).select(
        *frame.columns, "_source_file", (F.col("_mid") + F.col("_shift")).alias("_source_row")
    )


def _located_lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with the file and the split they lie in, their quotes and whether they are blank; in order within a split."""
    line = F.col("value")
    # Doubled quotes inside a field leave the parity as it is.
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return spark.read.option("lineSep", "\n").text(path).select(
        line.alias("_line"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_source_file"),
        F.col("_metadata.file_block_start").alias("_block"), quotes.cast("long").alias("_quotes"), F.regexp_like(line, F.lit("^\r?$")).alias("_blank"),
    )


def _split_tasks() -> tuple[Callable, Callable]:
    """The two Arrow tasks of ``quoted_records``; defined here, as executors do not have this module."""

    def by_split(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
        """The stretches of a batch that lie in one split."""
        if not batch.num_rows:
            return
        path, block = batch.column("_path").dictionary_encode(), batch.column("_block").to_numpy()
        code = path.indices.to_numpy()
        cuts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(block)), strict=True):
            yield (path.dictionary[int(code[lo])].as_py(), int(block[lo])), batch.slice(int(lo), int(hi - lo))

    def split_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parity of each split's quotes, and the records that begin in it for both entry states."""
        found: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for key, part in by_split(batch):
                total = found.setdefault(key, [0, 0, 0])
                quotes, blank = part.column("_quotes").to_numpy(), part.column("_blank").to_numpy(zero_copy_only=False)
                odd = (total[0] + np.cumsum(quotes) - quotes) % 2
                total[0] += int(quotes.sum())
                for state in (0, 1):
                    total[1 + state] += int(np.count_nonzero((odd == state) & ~blank))
        if found:
            columns = [pa.array([k[0] for k in found]), pa.array([k[1] for k in found], pa.int64()), pa.array([v[0] % 2 for v in found.values()], pa.int64())]
            columns += [pa.array([v[i] for v in found.values()], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names=["_path", "_block", "_parity", "_begin0", "_begin1"])

    class OpenRecord:
        """Where a split's reading stands: quotes and records so far, and the lines of a record not yet ended."""

        def __init__(self, key: tuple[str, int], part: pa.RecordBatch, state: tuple[int, int]) -> None:
            self.key, self.file = key, part.column("_source_file")[0].as_py()
            self.entry, self.last = state
            self.quotes, self.lines, self.begun = 0, [], False

    def record_texts(border: bool, states: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Texts of the records that lie in one split; or the pieces of those that cross a border of splits."""

        def rows(at: OpenRecord, records, texts) -> pa.RecordBatch:
            n = len(texts)
            columns = [pa.repeat(at.file, n), pa.repeat(at.key[0], n), pa.array(records, pa.int64()), pa.repeat(pa.scalar(at.key[1], pa.int64()), n), texts]
            return pa.RecordBatch.from_arrays(columns, names=["_source_file", "_path", "_record", "_block", "_text"])

        def left(at: OpenRecord | None) -> Iterator[pa.RecordBatch]:
            if border and at is not None and at.lines:
                yield rows(at, [at.last], pa.array(["\n".join(x for lines in at.lines for x in lines.to_pylist())]))

        def read(at: OpenRecord, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            quotes, blank = part.column("_quotes").to_numpy(), part.column("_blank").to_numpy(zero_copy_only=False)
            outside = (at.quotes + np.cumsum(quotes) - quotes) % 2 == at.entry
            at.quotes += int(quotes.sum())
            starts = outside & ~blank
            record = at.last + np.cumsum(starts)
            used = ~(outside & blank)
            lines, record, starts = part.column("_line").filter(pa.array(used)), record[used], starts[used]
            still_open = at.quotes % 2 != at.entry
            if still_open and not starts.any():
                at.lines.append(lines)
                return
            # What was open goes on with the first lines here.
            held = sum(map(len, at.lines))
            lines = pa.concat_arrays([*at.lines, lines])
            record = np.concatenate([np.full(held, at.last, np.int64), record])
            starts = np.concatenate([np.zeros(held, bool), starts])
            heads = np.flatnonzero(np.append(True, record[1:] != record[:-1])) if len(record) else np.zeros(0, np.int64)
            begun = starts[heads]
            if held and len(heads):
                begun[0] = at.begun
            whole, end = heads, len(record)
            at.lines = []
            if still_open:
                at.lines, at.begun, end, whole, begun = [lines[int(heads[-1]):]], bool(begun[-1]), int(heads[-1]), heads[:-1], begun[:-1]
            if len(record):
                at.last = int(record[-1])
            if len(whole):
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(whole, end), pa.int32()), lines[:end]), "\n")
                chosen = ~begun if border else begun
                if chosen.any():
                    yield rows(at, record[whole][chosen], texts.filter(pa.array(chosen)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = None
            for batch in batches:
                for key, part in by_split(batch):
                    if at is None or at.key != key:
                        yield from left(at)
                        at = OpenRecord(key, part, states.value[key])
                    yield from read(at, part)
            yield from left(at)

        return run

    return split_counts, record_texts


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``_source_file, _record, _text`` of CSV files whose quoted fields may hold line breaks.

    A line break ends a record where the quotes before it are even in number.  A split does not know
    how many came before it, so it reports its own parity and how many records begin in it for both
    entry states; a running combination over a file's splits then tells each one its state and its
    first record number.  Lines are read in order within their split and stay there; only the pieces
    of records that cross a border of splits are shuffled, at most two a split.
    Records are numbered from 1 in each file, the header included; blank lines are none.
    """
    lines, (split_counts, record_texts) = _located_lines(spark, path), _split_tasks()
    counts = lines.select("_path", "_block", "_quotes", "_blank").mapInArrow(split_counts, "_path string, _block long, _parity long, _begin0 long, _begin1 long")
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.coalesce(F.sum("_parity").over(earlier), F.lit(0).cast("long")) % 2
    splits = counts.withColumn("_entry", entry)
    here = F.when(F.col("_entry") == 0, F.col("_begin0")).otherwise(F.col("_begin1"))
    splits = splits.withColumn("_before", F.coalesce(F.sum(here).over(earlier), F.lit(0).cast("long")))
    # One row a split.  A join could change the order of the lines.
    states = spark.sparkContext.broadcast({(r["_path"], r["_block"]): (r["_entry"], r["_before"]) for r in splits.select("_path", "_block", "_entry", "_before").collect()})
    schema = "_source_file string, _path string, _record long, _block long, _text string"
    single = lines.mapInArrow(record_texts(False, states), schema).drop("_block")
    pieces = stored(lines.mapInArrow(record_texts(True, states), schema))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_text"))), lambda x: x["_text"]), "\n")
    several = pieces.groupBy("_source_file", "_path", "_record").agg(text.alias("_text"))
    ended = F.regexp_replace("_text", "\r$", "")
    return single.unionByName(several).select("_source_file", "_path", "_record", ended.alias("_text"))


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV with line breaks inside quotes, as text plus ``_source_file`` and ``_source_row``.

    Files are read in parallel splits; the first data row of a file is row 2.  All files must have
    the same header.
    """
    records = quoted_records(spark, path)
    headers = [r["_text"] for r in records.filter("_record = 1").select("_text").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError("Files have different headers" if headers else "No header found")
    names = next(csv.reader(io.StringIO(headers[0], newline="")))
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv("_text", fields, {"escape": '"'})
    return records.filter("_record > 1").select(parsed.alias("_r"), "_source_file", F.col("_record").alias("_source_row")).select("_r.*", "_source_file", "_source_row")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table, scanning only ``columns`` when given."""
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def version_path(root: str, version: str, table: str) -> str:
    """``root/version/table`` for a path-safe version name."""
    if not _VERSION.fullmatch(version) or ".." in version:
        raise ValueError(f"Version is not path safe: {version!r}")
    return f"{root}/{version}/{table}"


def write_parquet(
    df: DataFrame, root: str, version: str, table: str, partition_by: Sequence[str] = ()
) -> str:
    """Write one versioned table; an existing version is never overwritten."""
    path = version_path(root, version, table)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def significant_text(col, digits: int = 12):
    """Floats as ``%.12g`` style text: plain digits in the usual range, else exponent form."""
    value = col.cast("double")
    magnitude = F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - magnitude)
    plain = F.rint(value * scale) / scale
    text = F.regexp_replace(plain.try_cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    exponent = F.regexp_replace(F.format_string(f"%.{digits - 1}e", value), r"\.?0+e", "e")
    usual = (magnitude >= -4) & (magnitude < digits)
    return F.when(value == 0, F.lit("0")).when(usual, text).otherwise(exponent)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> str:
    """Headered CSV in a stable column order with 12 significant digits for floats."""
    order = list(columns or df.columns)
    kinds = dict(df.dtypes)
    shown = [
        significant_text(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c)
        for c in order
    ]
    df.select(*shown).write.mode("errorifexists").option("header", True).csv(path)
    return path


def record_text(df: DataFrame) -> DataFrame:
    """Each row as JSON text with sorted keys."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_json(df: DataFrame, path: str) -> str:
    record_text(df).write.mode("errorifexists").text(path)
    return path


def export_check(source: DataFrame, exported: DataFrame) -> DataFrame:
    """Row counts, column order and content differences of an export against its source."""
    same_columns = source.columns == exported.columns
    parts = [
        source.agg(F.count(F.lit(1)).alias("v")).select(F.lit("source_rows").alias("check"), "v"),
        exported.agg(F.count(F.lit(1)).alias("v")).select(F.lit("exported_rows").alias("check"), "v"),
        source.sparkSession.range(1).select(
            F.lit("columns_match").alias("check"), F.lit(int(same_columns)).cast("long").alias("v")
        ),
    ]
    if same_columns:
        from ..operators.contracts import table_differences

        changed = table_differences(source, exported, source.columns)
        names = F.when(F.col("side") == "lost", "missing_rows").otherwise("extra_rows")
        parts.append(changed.select(names.alias("check"), F.col("rows").alias("v")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("v", "value")


__all__ = [
    "export_check", "quoted_records", "read_csv", "read_parquet", "read_quoted_csv", "record_text", "significant_text",
    "version_path", "write_csv", "write_json", "write_parquet",
]
