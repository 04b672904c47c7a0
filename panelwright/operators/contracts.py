"""Declarative contracts compiled to column expressions, with quarantine and an issue ledger.

``annotate`` adds the cleaned columns, an array of findings and the reject reasons of every row in
one projection; only duplicate retention needs a shuffle.  Valid rows, rejected rows and the ledger
are three views of that plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import attach_by_key, settle, spread, stored
from ..functions.scalars import array_sum, is_blank, json_text, to_number
from ..functions.windows import PanelSpec, over_chunks, plus_steps

# Dispositions and reason codes of the ledger.
CELL = "cell_invalidated"
ROW = "row_rejected"
DATASET = "dataset_rejected"

_FINDING = (
    "struct<field:string,rejected_value:string,reason_code:string,disposition:string,message:string,"
    "retained_source_row:bigint>"
)
LEDGER = (
    "dataset", "source_file", "source_row", "field", "rejected_value", "reason_code", "disposition",
    "message", "retained_source_row",
)


@dataclass(frozen=True)
class Text:
    name: str
    nullable: bool = False
    disposition: str = ROW


@dataclass(frozen=True)
class Category:
    """``allowed`` is exact; ``mapping`` keys are compared trimmed and case-folded."""

    name: str
    allowed: tuple[str, ...] = ()
    mapping: dict[str, str] | None = None
    nullable: bool = False
    report_missing: bool = False
    disposition: str = ROW


@dataclass(frozen=True)
class Number:
    name: str
    integer: bool = False
    nullable: bool = False
    report_missing: bool = False
    disposition: str = CELL
    invalid_reason: str = "invalid_type"
    allowed: tuple[float, ...] = ()
    minimum: float | None = None
    exclusive_minimum: bool = False
    minimum_reason: str = "invalid_numeric_range"
    maximum: float | None = None
    maximum_reason: str = "invalid_numeric_range"


@dataclass(frozen=True)
class Shares:
    name: str
    keys: tuple[str, ...]
    low: float = 0.0
    high: float = 1.0
    expected_sum: float = 1.0
    tolerance: float = 0.02
    disposition: str = CELL


@dataclass(frozen=True)
class Clock:
    """Strict text timestamp; without ``time`` the result is the date at midnight."""

    date: str
    date_regex: str
    date_format: str
    output: str
    time: str | None = None
    time_regex: str | None = None
    time_format: str | None = None
    every_minutes: int = 30
    zone: str | None = None


@dataclass(frozen=True)
class Contract:
    dataset: str
    columns: tuple[str, ...]
    clock: Clock
    key: tuple[str, ...]
    texts: tuple[Text, ...] = ()
    categories: tuple[Category, ...] = ()
    numbers: tuple[Number, ...] = ()
    shares: tuple[Shares, ...] = ()
    flag_names: tuple[tuple[str, str], ...] = ()
    lineage: tuple[str, str] = field(default=("source_file", "source_row"))


@dataclass(frozen=True)
class Validated:
    valid: DataFrame
    rejected: DataFrame
    issues: DataFrame
    annotated: DataFrame


def schema_problems(columns: Sequence[str], contract: Contract) -> list[tuple[str, str]]:
    """(reason, column) of every missing and unexpected column; empty when the schema is exact."""
    seen = [c for c in columns if c not in contract.lineage]
    missing = [("missing_required_column", c) for c in contract.columns if c not in seen]
    return missing + [("unexpected_column", c) for c in seen if c not in contract.columns]


def detect(columns: Sequence[str], contracts: Sequence[Contract]) -> Contract | None:
    """The contract whose column set equals the delivered one."""
    seen = {c for c in columns}
    for contract in contracts:
        if seen - set(contract.lineage) == set(contract.columns):
            return contract
    return None


def finding(bad: Column, name: str, reason: str, disposition: str, message: str, raw: Column | None = None) -> Column:
    """Finding struct where ``bad`` holds, else null."""
    record = F.struct(
        F.lit(name).alias("field"),
        (json_text(raw) if raw is not None else F.lit(None).cast("string")).alias("rejected_value"),
        F.lit(reason).alias("reason_code"),
        F.lit(disposition).alias("disposition"),
        F.lit(message).alias("message"),
        F.lit(None).cast("bigint").alias("retained_source_row"),
    )
    return F.when(F.coalesce(bad, F.lit(False)), record)


def text_findings(rule: Text) -> list[Column]:
    if rule.nullable:
        return []
    col = F.col(rule.name)
    return [finding(is_blank(col), rule.name, "missing_value", rule.disposition, "Required string value is blank", col)]


def category_invalid(rule: Category) -> Column:
    col = F.col(rule.name).cast("string")
    known = F.lower(F.trim(col)).isin(*rule.mapping) if rule.mapping else col.isin(*rule.allowed)
    return ~is_blank(col) & ~known


def category_findings(rule: Category) -> list[Column]:
    col = F.col(rule.name)
    out = []
    if not rule.nullable or rule.report_missing:
        reason = "missing_key" if rule.disposition == ROW else "missing_value"
        out.append(finding(is_blank(col), rule.name, reason, rule.disposition, "Categorical value is blank", col))
    out.append(
        finding(
            category_invalid(rule), rule.name, "invalid_category", rule.disposition,
            "Value is outside the configured categorical vocabulary", col,
        )
    )
    return out


def number_checks(rule: Number, value: Column | None = None) -> dict[str, Column]:
    """Named predicates of a numeric rule; ``value`` is its parsed column where one exists."""
    col = F.col(rule.name)
    value = to_number(col) if value is None else value
    bad_type = ~is_blank(col) & value.isNull()
    if rule.integer:
        bad_type = bad_type | F.coalesce(value % 1 != 0, F.lit(False))
    usable = value.isNotNull() & ~bad_type
    checks = {"type": bad_type}
    if not rule.nullable or rule.report_missing:
        checks["missing"] = is_blank(col)
    if rule.allowed:
        checks["allowed"] = usable & ~value.isin(*rule.allowed)
    if rule.minimum is not None:
        below = value <= rule.minimum if rule.exclusive_minimum else value < rule.minimum
        checks["minimum"] = usable & below
    if rule.maximum is not None:
        checks["maximum"] = usable & (value > rule.maximum)
    return checks


def number_findings(rule: Number, value: Column | None = None) -> list[Column]:
    texts = {
        "type": (rule.invalid_reason, "Value cannot be coerced to the configured numeric type"),
        "missing": ("missing_value", "Numeric value is missing"),
        "allowed": (rule.invalid_reason, "Numeric value is outside the configured allowed set"),
        "minimum": (rule.minimum_reason, "Numeric value is below the configured physical minimum"),
        "maximum": (rule.maximum_reason, "Numeric value exceeds the configured physical maximum"),
    }
    return [
        finding(bad, rule.name, texts[kind][0], rule.disposition, texts[kind][1], F.col(rule.name))
        for kind, bad in number_checks(rule, value).items()
    ]


def number_value(rule: Number, value: Column | None = None) -> Column:
    """Typed value with invalid cells as null."""
    value = to_number(F.col(rule.name)) if value is None else value
    bad = F.lit(False)
    for kind, check in number_checks(rule, value).items():
        if kind != "missing":
            bad = bad | check
    return F.when(~bad, value).cast("long" if rule.integer else "double")


def shares_valid(rule: Shares) -> Column:
    """The text is an object with exactly the keys, each share in range, summing to the target."""
    parsed = F.from_json(F.col(rule.name), "map<string,double>")
    names = F.array(*[F.lit(k) for k in sorted(rule.keys)])
    ok = (
        (F.array_sort(F.map_keys(parsed)) == names)
        & F.forall(F.map_values(parsed), lambda v: v.isNotNull() & v.between(rule.low, rule.high))
        & (F.abs(array_sum(F.map_values(parsed)) - rule.expected_sum) <= rule.tolerance)
    )
    return F.coalesce(ok, F.lit(False))


def share_findings(rule: Shares, valid: Column | None = None) -> list[Column]:
    message = "JSON object must contain valid near-unit vehicle-class shares"
    valid = shares_valid(rule) if valid is None else valid
    return [finding(~valid, rule.name, "invalid_json", rule.disposition, message, F.col(rule.name))]


def clock_value(rule: Clock) -> Column:
    """Parsed timestamp (or date) when text, calendar and cadence all hold, else null."""
    date = F.col(rule.date).cast("string")
    ok = F.regexp_like(date, F.lit(f"^(?:{rule.date_regex})$"))
    if rule.time:
        time = F.col(rule.time).cast("string")
        parsed = F.try_to_timestamp(F.concat(date, F.lit(" "), time), F.lit(f"{rule.date_format} {rule.time_format}"))
        parsed = parsed.cast("timestamp_ntz")
        ok = ok & F.regexp_like(time, F.lit(f"^(?:{rule.time_regex})$")) & (F.minute(parsed) % rule.every_minutes == 0)
    else:
        parsed = F.try_to_timestamp(date, F.lit(rule.date_format)).cast("timestamp_ntz")
    value = F.when(ok, parsed)
    if rule.zone:
        return F.convert_timezone(F.lit(rule.zone), F.current_timezone(), value).cast("timestamp")
    return value if rule.time else F.to_date(value)


def clock_findings(rule: Clock, value: Column | None = None) -> list[Column]:
    name = rule.time or rule.date
    message = "Date/time does not match the exact source format and frequency"
    value = clock_value(rule) if value is None else value
    return [finding(value.isNull(), name, "invalid_timestamp", ROW, message, F.col(name))]


def flag_name_findings(contract: Contract, values: dict[str, Column] | None = None) -> list[Column]:
    """Name required at flag 1 and forbidden at flag 0; the flag is read after numeric cleaning."""
    rules, values = {n.name: n for n in contract.numbers}, values or {}
    out = []
    for flag, name in contract.flag_names:
        parsed = values.get(flag)
        value = number_value(rules[flag], parsed) if flag in rules else to_number(F.col(flag))
        blank, raw = is_blank(F.col(name)), F.col(name)
        out.append(finding((value == 1) & blank, name, "missing_flag_name", ROW, f"{name} is required when {flag}=1", raw))
        out.append(finding((value == 0) & ~blank, name, "unexpected_flag_name", ROW, f"{name} must be blank when {flag}=0", raw))
    return out


def _reasons(findings: Column) -> Column:
    rejected = F.filter(findings, lambda i: i["disposition"] == ROW)
    return F.array_sort(F.array_distinct(F.transform(rejected, lambda i: i["reason_code"])))


def annotate_cells(df: DataFrame, contract: Contract) -> DataFrame:
    """All per-row rules: cleaned columns, ``_raw``, ``_findings`` and ``_reject``.

    No shuffle, but for a scan with fewer splits than cores.
    Text is parsed once into settled columns; findings and reject reasons are settled in turn.
    """
    parsed = {f"_n_{n.name}": to_number(F.col(n.name)) for n in contract.numbers}
    parsed |= {f"_s_{x.name}": shares_valid(x) for x in contract.shares}
    parsed["_clock"] = clock_value(contract.clock)
    out = settle(spread(df), parsed)
    values = {n.name: F.col(f"_n_{n.name}") for n in contract.numbers}
    found: list[Column] = []
    for text in contract.texts:
        found += text_findings(text)
    for category in contract.categories:
        found += category_findings(category)
    for number in contract.numbers:
        found += number_findings(number, values[number.name])
    for share in contract.shares:
        found += share_findings(share, F.col(f"_s_{share.name}"))
    found += clock_findings(contract.clock, F.col("_clock"))
    found += flag_name_findings(contract, values)
    cleaned: dict[str, Column] = {}
    for category in contract.categories:
        if category.disposition == CELL:
            col = F.col(category.name)
            cleaned[category.name] = F.when(~(is_blank(col) | category_invalid(category)), col)
    for number in contract.numbers:
        cleaned[number.name] = number_value(number, values[number.name])
    for share in contract.shares:
        if share.disposition == CELL:
            cleaned[share.name] = F.when(F.col(f"_s_{share.name}"), F.col(share.name))
    cleaned[contract.clock.output] = F.col("_clock")
    out = settle(
        out,
        {
            "_raw": F.struct(*[F.col(c) for c in contract.columns]),
            "_findings": F.array_compact(F.array(*found)).cast(f"array<{_FINDING}>"),
            **cleaned,
        },
    ).drop(*parsed)
    no_key = F.lit(False)
    for part in contract.key:
        no_key = no_key | F.col(part).isNull()
    earlier = F.exists("_findings", lambda i: i["disposition"] == ROW)
    missing = finding(
        no_key & ~earlier, "|".join(contract.key), "missing_key", ROW,
        "One or more uniqueness-key fields are missing",
    )
    out = settle(out, {"_findings": F.array_compact(F.array_append("_findings", missing.cast(_FINDING)))})
    return settle(out, {"_reject": _reasons(F.col("_findings"))})


def _raw_hash(columns: Sequence[str]) -> Column:
    """128 bits of a row's raw values; nulls count by their place."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    return F.struct(F.xxhash64(nulls, *columns).alias("a"), F.xxhash64(F.lit(1), nulls, *columns).alias("b"))


def winners_by_key(marked: DataFrame, contract: Contract) -> DataFrame:
    """Most complete, then lowest-numbered surviving row of every key that has several.

    ``_copies, _kept_row, _kept_hash``; only the key, the row number, the completeness and a hash of
    the raw values are read and shuffled.
    """
    source_row = contract.lineage[1]
    keys = list(contract.key)
    order = F.struct(F.col("_complete").alias("c"), (-F.col(source_row)).alias("r"))
    return marked.filter(F.size("_reject") == 0).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_copies"), F.max(F.struct(order.alias("o"), F.col(source_row).alias("row"), F.col("_hash").alias("hash"))).alias("_w")
    ).filter("_copies > 1").select(*keys, "_copies", F.col("_w.row").alias("_kept_row"), F.col("_w.hash").alias("_kept_hash"))


def retain_one_per_key(df: DataFrame, contract: Contract) -> DataFrame:
    """Reject all but the most complete, then lowest-numbered surviving row of each key.

    The annotated rows are stored once; the winners come from their slim columns and are stored as
    well, and the annotated rows then meet them once, hot keys by a bounded broadcast.
    """
    source_row = contract.lineage[1]
    keys = list(contract.key)
    filled = [F.col(c).isNotNull().cast("int") for c in contract.columns]
    marked = stored(df.withColumns({"_complete": sum(filled[1:], filled[0]), "_hash": _raw_hash([f"_raw.{c}" for c in contract.columns])}))
    joined = attach_by_key(marked, stored(winners_by_key(marked, contract)), keys, "_copies", salt=[source_row])
    lost = (F.size("_reject") == 0) & F.col("_kept_row").isNotNull() & (F.col(source_row) != F.col("_kept_row"))
    exact = F.col("_hash") == F.col("_kept_hash")
    duplicate = F.when(
        lost,
        F.struct(
            F.lit("|".join(keys)).alias("field"),
            F.lit(None).cast("string").alias("rejected_value"),
            F.lit("duplicate_key").alias("reason_code"),
            F.lit(ROW).alias("disposition"),
            F.concat(F.lit("Duplicate key removed; exact_duplicate="), exact.cast("string")).alias("message"),
            F.col("_kept_row").alias("retained_source_row"),
        ),
    )
    out = settle(joined, {"_findings": F.array_compact(F.array_append("_findings", duplicate))})
    return settle(out, {"_reject": _reasons(F.col("_findings"))}).drop("_copies", "_kept_row", "_kept_hash", "_complete", "_hash")


def annotate(df: DataFrame, contract: Contract) -> DataFrame:
    return retain_one_per_key(annotate_cells(df, contract), contract)


def _reject_all(df: DataFrame, contract: Contract, problems: list[tuple[str, str]]) -> Validated:
    reasons = "|".join(sorted({reason for reason, _ in problems}))
    rejected = df.withColumns({"validation_status": F.lit("rejected"), "rejection_reason": F.lit(reasons)})
    message = {
        "missing_required_column": "Required column is absent: ",
        "unexpected_column": "Unexpected source column is present: ",
    }
    found = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"), F.lit(None).cast("string").alias("rejected_value"),
                F.lit(reason).alias("reason_code"), F.lit(DATASET).alias("disposition"),
                F.lit(message[reason] + name).alias("message"),
            )
            for reason, name in problems
        ]
    )
    issues = df.sparkSession.range(1).select(F.explode(found).alias("i")).select(
        F.lit(contract.dataset).alias("dataset"), F.lit(None).cast("string").alias("source_file"),
        F.lit(None).cast("bigint").alias("source_row"), "i.*",
        F.lit(None).cast("bigint").alias("retained_source_row"),
    )
    return Validated(df.limit(0), rejected, issues.select(*LEDGER), rejected)


def valid_rows(annotated: DataFrame) -> DataFrame:
    """Surviving rows with cleaned cells; ``valid_with_issues`` when a cell was invalidated."""
    touched = F.exists("_findings", lambda i: i["disposition"] == CELL)
    return (
        annotated.filter(F.size("_reject") == 0)
        .withColumn("validation_status", F.when(touched, "valid_with_issues").otherwise("valid"))
        .drop("_raw", "_findings", "_reject")
    )


def rejected_rows(annotated: DataFrame, contract: Contract) -> DataFrame:
    """Rejected rows with raw values and their sorted, joined reasons."""
    extra = [c for c in (contract.clock.output,) if c not in contract.columns]
    return annotated.filter(F.size("_reject") > 0).select(
        *contract.lineage, "_raw.*", *extra, F.lit("rejected").alias("validation_status"),
        F.array_join("_reject", "|").alias("rejection_reason"),
    )


def issue_ledger(annotated: DataFrame, contract: Contract) -> DataFrame:
    """One row per finding."""
    source_file, source_row = contract.lineage
    return annotated.select(
        F.lit(contract.dataset).alias("dataset"), F.col(source_file).alias("source_file"),
        F.col(source_row).cast("long").alias("source_row"), F.explode("_findings").alias("i"),
    ).select("dataset", "source_file", "source_row", "i.*").select(*LEDGER)


def sort_ledger(issues: DataFrame) -> DataFrame:
    return issues.orderBy(
        F.coalesce("source_row", F.lit(-1)), F.coalesce("field", F.lit("")), "reason_code", "disposition"
    )


def validate(df: DataFrame, contract: Contract) -> Validated:
    """Closed-schema check, then all row rules, then duplicate retention."""
    problems = schema_problems(df.columns, contract)
    if problems:
        return _reject_all(df, contract, problems)
    marked = annotate(df, contract)
    return Validated(valid_rows(marked), rejected_rows(marked, contract), issue_ledger(marked, contract), marked)


def issue_counts(issues: DataFrame) -> DataFrame:
    """Counts by reason and by disposition in one pass."""
    pairs = F.array(
        F.struct(F.lit("reason").alias("kind"), F.col("reason_code").alias("code")),
        F.struct(F.lit("disposition").alias("kind"), F.col("disposition").alias("code")),
    )
    return issues.select(F.explode(pairs).alias("r")).select("r.*").groupBy("kind", "code").agg(
        F.count(F.lit(1)).alias("issues")
    )


def row_accounting(annotated: DataFrame, dataset: str) -> DataFrame:
    """Input = valid + rejected."""
    ok = F.size("_reject") == 0
    return annotated.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(ok).alias("valid_rows"), F.count_if(~ok).alias("rejected_rows")
    ).select(
        F.lit(dataset).alias("dataset"), "*",
        (F.col("input_rows") == F.col("valid_rows") + F.col("rejected_rows")).alias("accounted"),
    )


def accounting_with_total(annotated: DataFrame, dataset: str, total: str = "total") -> DataFrame:
    """Accounting of several deliveries named by a column, and of all of them, in one aggregate."""
    ok = F.size("_reject") == 0
    sums = annotated.rollup(dataset).agg(
        F.grouping(dataset).alias("_all"), F.count(F.lit(1)).alias("input_rows"), F.count_if(ok).alias("valid_rows"), F.count_if(~ok).alias("rejected_rows")
    )
    return sums.select(
        F.when(F.col("_all") == 1, total).otherwise(F.col(dataset)).alias("dataset"), "input_rows", "valid_rows", "rejected_rows",
        (F.col("input_rows") == F.col("valid_rows") + F.col("rejected_rows")).alias("accounted"),
    )


def upload_report(df: DataFrame, contracts: Sequence[Contract]) -> dict[str, DataFrame | str | None]:
    """Detected contract, accounting, 100-row previews and the first 500 issues of a delivery."""
    contract = detect(df.columns, contracts)
    if contract is None:
        return {"dataset": None}
    result = validate(df, contract)
    row = contract.lineage[1]
    return {
        "dataset": contract.dataset,
        "accounting": row_accounting(result.annotated, contract.dataset),
        "valid_preview": result.valid.orderBy(row).limit(100),
        "rejected_preview": result.rejected.orderBy(row).limit(100),
        "issues": sort_ledger(result.issues).limit(500),
    }


# -- assertions over tables: violations frames, with thin raising wrappers ------------------------


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def require_unique(df: DataFrame, key: Sequence[str]) -> None:
    found = duplicate_keys(df, key).limit(1).collect()
    if found:
        raise ValueError(f"Key is not unique: {found[0].asDict()}")


def cadence_breaks(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Steps of an entity that do not follow the previous one by exactly one cadence.

    The halo covers one step, and an earlier row further back is a break all the same; the first
    row of an entity is found by its minimum timestamp, not by a window over the entity.
    """

    def build(w):
        return {"_prev": F.lag(spec.ts).over(w)}

    seen = over_chunks(df.select(spec.entity, spec.ts), spec, build, back=1)
    first = df.groupBy(spec.entity).agg(F.min(spec.ts).alias("_first"))
    late = F.col("_prev").isNull() | (plus_steps(F.col("_prev"), 1, spec) != F.col(spec.ts))
    return seen.join(first, spec.entity).filter((F.col(spec.ts) != F.col("_first")) & late).select(spec.entity, spec.ts)


def incomplete_timestamps(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Timestamps that do not hold every entity."""
    entities = df.agg(F.count_distinct(spec.entity)).scalar()
    return (
        df.groupBy(spec.ts).agg(F.count_distinct(spec.entity).alias("entities")).filter(F.col("entities") != entities)
    )


def calendar_differences(df: DataFrame, spec: PanelSpec, start: Column, end: Column) -> DataFrame:
    """Per entity, timestamps missing from or beyond the configured calendar.

    Each entity makes its own calendar by a generator; nothing is paired with every timestamp.
    """
    keys = [spec.entity, spec.ts]
    present = df.select(*keys).distinct()
    step = F.expr(f"INTERVAL {spec.cadence_minutes} MINUTES")
    wanted = df.select(spec.entity).distinct().select(spec.entity, F.explode(F.sequence(start, end, step)).alias(spec.ts))
    missing = wanted.join(present, keys, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(present.join(wanted, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def multiset_checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and order-free sums of two 64-bit row hashes, in four parts, in one row.

    Equal multisets of rows have equal sums, whatever their order and partitions.  The sums combine
    map-side: a row of numbers leaves each task.
    """
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    values = [F.to_json(F.col(c)) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.select(*columns).dtypes]
    hashes = {"a": F.xxhash64(nulls, *values), "b": F.xxhash64(F.lit(7), nulls, *values)}
    low, high = F.lit(0xFFFFFFFF), 32
    sums = []
    for name, h in hashes.items():
        sums += [F.sum(h.bitwiseAND(low)).alias(f"{name}_low"), F.sum(F.shiftright(h, high)).alias(f"{name}_high")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *sums)
    return row.select("rows", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in row.columns if c != "rows"])


def table_differences(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``changed_rows``, whose shuffles run only where the checksums differ."""
    if multiset_checksum(before, columns).first() == multiset_checksum(after, columns).first():
        return before.sparkSession.createDataFrame([(0, "lost"), (0, "added")], "rows bigint, side string")
    return changed_rows(before, after, columns)


def changed_rows(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``columns`` that a stage lost or added: both empty means untouched inputs."""
    a, b = before.select(*columns), after.select(*columns)
    return (
        a.exceptAll(b).agg(F.count(F.lit(1)).alias("rows")).withColumn("side", F.lit("lost"))
        .unionByName(b.exceptAll(a).agg(F.count(F.lit(1)).alias("rows")).withColumn("side", F.lit("added")))
    )


def reconcile(counters: DataFrame) -> DataFrame:
    """Nine cross-stage checks over a ``(stage, counter, value)`` table."""
    wide = counters.groupBy().agg(
        *[
            F.max(F.when((F.col("stage") == s) & (F.col("counter") == c), F.col("value"))).alias(f"{s}_{c}")
            for s, c in COUNTERS
        ]
    )
    v = F.col
    checks = {
        "raw_validation_input_rows": v("raw_rows") == v("validation_input"),
        "validation_row_accounting": v("validation_valid") + v("validation_rejected") == v("validation_input"),
        "traffic_duplicate_accounting": v("facts_raw") - v("facts_duplicates") == v("facts_input"),
        "traffic_grid_accounting": v("facts_input") + v("facts_inserted") == v("facts_output"),
        "context_rows_preserved": (v("hourly_input") == v("hourly_output")) & (v("daily_input") == v("daily_output")),
        "merge_cardinality": (v("merge_output") == v("facts_output")) & (v("merge_duplicates") == 0),
        "join_coverage": (v("merge_hourly_missing") == 0) & (v("merge_daily_missing") == 0),
        "feature_cardinality": (v("feature_input") == v("feature_output")) & (v("feature_output") == v("merge_output")),
        "processed_cardinality": (v("processed_input") == v("processed_output"))
        & (v("processed_output") == v("feature_output")),
    }
    rows = F.array(
        *[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


COUNTERS = (
    ("raw", "rows"),
    ("validation", "input"),
    ("validation", "valid"),
    ("validation", "rejected"),
    ("facts", "raw"),
    ("facts", "duplicates"),
    ("facts", "input"),
    ("facts", "inserted"),
    ("facts", "output"),
    ("hourly", "input"),
    ("hourly", "output"),
    ("daily", "input"),
    ("daily", "output"),
    ("merge", "output"),
    ("merge", "duplicates"),
    ("merge", "hourly_missing"),
    ("merge", "daily_missing"),
    ("feature", "input"),
    ("feature", "output"),
    ("processed", "input"),
    ("processed", "output"),
)
