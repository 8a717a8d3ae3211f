"""Validation rules. All counters of a rule list are computed in a single aggregation."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Required columns of sales and forecast rows.
SALES_COLUMNS = ("product_id", "sales", "date")
FORECAST_COLUMNS = ("product_id", "forecast_date", "predicted_demand")

# Which Spark types satisfy an expected type name. Booleans count as integers.
TYPE_CLASSES: dict[str, tuple[type, ...]] = {
    "str": (T.StringType,),
    "int": (T.IntegralType, T.BooleanType),
    "float": (T.FractionalType,),
    "bool": (T.BooleanType,),
    "list": (T.ArrayType,),
    "dict": (T.StructType, T.MapType),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
}
# SQL type used to test whether a string holds a value of the expected type.
CAST_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp"}

RESULT_SCHEMA = T.StructType([
    T.StructField("is_valid", T.BooleanType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


@dataclass
class ValidationResult:
    is_valid: bool = True
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)

    def fail(self, message: str) -> None:
        self.is_valid = False
        self.errors.append(message)


@dataclass(frozen=True)
class Check:
    """One rule of a frame: a failure found in the schema, or a condition counted over the rows."""

    rule: str
    column: str
    message: str  # may hold {n}, the number of offending rows
    offending: Column | None = None  # None: the schema alone fails the rule

    def text(self, n: int) -> str:
        return self.message.format(n=n)


# Column that holds the type of each value of a record, and the types that count as another one.
RECORD_TYPES = "_record_types"
RECORD_ACCEPTS = {"int": ("int", "bool"), "float": ("float",)}


def _is_type(df: DataFrame, column: str, expected: str) -> bool:
    return isinstance(df.schema[column].dataType, TYPE_CLASSES[expected])


def type_checks(df: DataFrame, types: dict[str, str], rule: str = "data_type") -> list[Check]:
    """Columns must hold the expected type. String columns pass if every value converts."""
    checks = []
    for column, expected in types.items():
        if column not in df.columns or expected not in TYPE_CLASSES:
            continue
        if RECORD_TYPES in df.columns:
            # Records tell the type of each of their values.
            known = F.col(RECORD_TYPES)[column]
            bad = F.coalesce(~known.isin(*RECORD_ACCEPTS.get(expected, (expected,))), F.lit(False))
            checks.append(Check(rule, column, f"Expected type {expected} in {column}, got {{n}} other values", bad))
            continue
        if _is_type(df, column, expected):
            continue
        actual = df.schema[column].dataType.simpleString()
        if actual == "string" and expected in CAST_TYPES:
            bad = F.col(column).isNotNull() & F.col(column).try_cast(CAST_TYPES[expected]).isNull()
            checks.append(Check(rule, column, f"Expected type {expected} in {column}, got {{n}} other values", bad))
        else:
            checks.append(Check(rule, column, f"Expected type {expected} in {column}, got {actual}"))
    return checks


def range_checks(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> list[Check]:
    """Inclusive bounds, either of them optional."""
    if column not in df.columns:
        return [Check("range", column, f"Cannot validate range of missing column: {column}")]
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.NumericType, T.BooleanType)):
        return [Check("range", column, f"Cannot validate range for non-numeric data: {kind.simpleString()}")]
    value = F.col(column).cast("double")
    value = F.when(~F.isnan(value), value)
    checks = []
    if low is not None:
        checks.append(Check("range_min", column, f"{{n}} values of {column} are less than minimum {low}", value < low))
    if high is not None:
        checks.append(
            Check("range_max", column, f"{{n}} values of {column} are greater than maximum {high}", value > high))
    return checks


def required_checks(df: DataFrame, fields: Sequence[str]) -> list[Check]:
    """Record fields: absent from the schema, or null in some records."""
    checks = []
    for name in fields:
        message = f"Missing required field: {name}"
        checks.append(Check("required", name, message, F.col(name).isNull() if name in df.columns else None))
    return checks


def column_checks(df: DataFrame, columns: Sequence[str]) -> list[Check]:
    return [
        Check("columns", c, f"Missing required column: {c}") for c in columns if c not in df.columns
    ]


def _not_negative(df: DataFrame, column: str, message: str) -> list[Check]:
    if column not in df.columns:
        return []
    value = F.col(column).cast("double")
    return [Check("negative", column, message, F.when(~F.isnan(value), value) < 0)]


def _not_null(df: DataFrame, columns: Sequence[str]) -> list[Check]:
    return [Check("null", c, f"Found {{n}} null values in {c}", F.col(c).isNull())
            for c in columns if c in df.columns]


def sales_checks(df: DataFrame, required: Sequence[str] = SALES_COLUMNS, reject_null: bool = False) -> list[Check]:
    checks = column_checks(df, required) + _not_negative(df, "sales", "Found {n} negative sales values")
    return checks + (_not_null(df, ("sales", "product_id")) if reject_null else [])


def forecast_checks(df: DataFrame, reject_null: bool = False) -> list[Check]:
    checks = column_checks(df, FORECAST_COLUMNS)
    checks += _not_negative(df, "predicted_demand", "Found {n} negative demand predictions")
    return checks + (_not_null(df, ("predicted_demand",)) if reject_null else [])


def configured_checks(df: DataFrame, rules: Sequence[dict[str, Any]]) -> list[Check]:
    """Checks of a rule list in order; rules of an unknown type are ignored."""
    built = [BUILDERS[rule["type"]](df, rule) for rule in rules if rule.get("type") in BUILDERS]
    return [check for checks in built for check in checks]


def _schema_rule(df: DataFrame, rule: dict[str, Any]) -> list[Check]:
    schema = rule.get("schema") or {}
    return required_checks(df, schema.get("required") or []) + type_checks(df, schema.get("types") or {}, rule="schema")


BUILDERS: dict[str, Callable[[DataFrame, dict[str, Any]], list[Check]]] = {
    "sales": lambda df, r: sales_checks(df, r.get("required_columns", SALES_COLUMNS), r.get("reject_null", False)),
    "forecast": lambda df, r: forecast_checks(df, r.get("reject_null", False)),
    "range": lambda df, r: range_checks(df, r["column"], r.get("min"), r.get("max")) if r.get("column") else [],
    "data_type": lambda df, r: type_checks(df, r.get("types") or {}),
    "schema": _schema_rule,
}


def count_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: ``rule, column, offending, rows``. A schema failure has a null count."""
    counted = [F.count(F.lit(1)).alias("rows")] + [
        (F.lit(None).cast("bigint") if c.offending is None else F.count_if(c.offending)).alias(f"c{i}")
        for i, c in enumerate(checks)
    ]
    items = [
        F.struct(F.lit(c.rule).alias("rule"), F.lit(c.column).alias("column"),
                 F.col(f"c{i}").alias("offending"), F.col("rows").alias("rows"))
        for i, c in enumerate(checks)
    ]
    return df.agg(*counted).select(F.explode(F.array(*items)).alias("x")).select("x.*")


def write_counted(df: DataFrame, checks: Sequence[Check], path: str, mode: str = "errorifexists") -> DataFrame:
    """Write the rows as Parquet and return the counters of the checks, in the form of :func:`count_checks`.

    The counters are gathered as observed metrics while the rows pass to the files: the input is read once, and
    no job beside the write runs. They speak of exactly the rows written.
    """
    observation = Observation(f"checks-{uuid.uuid4().hex}")
    counted = [F.count(F.lit(1)).alias("rows")] + [
        F.count_if(c.offending).alias(f"c{i}") for i, c in enumerate(checks) if c.offending is not None]
    df.observe(observation, *counted).write.mode(mode).parquet(path)
    found = observation.get
    rows = [(c.rule, c.column, found.get(f"c{i}"), found["rows"]) for i, c in enumerate(checks)]
    return df.sparkSession.createDataFrame(rows, "rule string, column string, offending long, rows long")


def run_checks(df: DataFrame, checks: Sequence[Check], warn_empty: bool = True) -> ValidationResult:
    """Evaluate all checks in one pass; an empty frame is a warning, not an error."""
    result = ValidationResult()
    counters = [F.count(F.lit(1)).alias("rows")] + [
        F.count_if(c.offending).alias(f"c{i}") for i, c in enumerate(checks) if c.offending is not None
    ]
    row = df.agg(*counters).first()
    if warn_empty and row["rows"] == 0:
        result.warnings.append("DataFrame is empty")
    for i, check in enumerate(checks):
        n = None if check.offending is None else row[f"c{i}"]
        if n is None or n > 0:
            result.fail(check.text(n or 0))
    result.metadata["row_count"] = str(row["rows"])
    return result


def validate(df: DataFrame, rules: Sequence[dict[str, Any]]) -> ValidationResult:
    return run_checks(df, configured_checks(df, rules))


def validate_records(spark: SparkSession, data: Any, rules: Sequence[dict[str, Any]]) -> ValidationResult:
    """Validate a frame, one record, or a list of records; anything else is an error result."""
    if isinstance(data, DataFrame):
        return validate(data, rules)
    records = [data] if isinstance(data, dict) else data
    if not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
        result = ValidationResult()
        result.fail(f"Invalid data type: {type(data)}")
        return result
    return validate(_record_frame(spark, records), rules)


def _record_frame(spark: SparkSession, records: list[dict[str, Any]]) -> DataFrame:
    """Records as rows: numbers where all values of a field are numbers, else text, and the type of each value."""
    names = list(dict.fromkeys(name for record in records for name in record))
    numeric = {n for n in names if all(isinstance(r.get(n), (int, float, type(None))) for r in records)}

    def cell(name: str, value: Any) -> Any:
        if value is None:
            return None
        return float(value) if name in numeric else str(value)

    schema = T.StructType([*[T.StructField(n, T.DoubleType() if n in numeric else T.StringType()) for n in names],
                           T.StructField(RECORD_TYPES, T.MapType(T.StringType(), T.StringType()))])
    rows = [(*[cell(n, r.get(n)) for n in names],
             {n: type(v).__name__ for n, v in r.items() if v is not None}) for r in records]
    return spark.createDataFrame(rows, schema)


def validate_sales(df: DataFrame, **options) -> ValidationResult:
    return run_checks(df, sales_checks(df, **options))


def validate_forecast(df: DataFrame, **options) -> ValidationResult:
    return run_checks(df, forecast_checks(df, **options))


def validate_file(spark: SparkSession, path: str, rules: Sequence[dict[str, Any]]) -> ValidationResult:
    """Validate a JSON or CSV file; a file that cannot be read is an error result, never a raise."""
    from shelfcast.sources.files import read_csv, read_json

    result = ValidationResult()
    readers = {"json": read_json, "csv": read_csv}
    reader = readers.get(path.rsplit(".", 1)[-1])
    try:
        if reader is None:
            result.fail(f"Unsupported file type: {path}")
            return result
        return validate(reader(spark, path), rules)
    except Exception as problem:  # the contract is a result, whatever went wrong
        if "PATH_NOT_FOUND" in str(problem):
            result.fail(f"File not found: {path}")
        else:
            result.fail(f"Error reading file: {problem}")
        return result


def tag_rows(df: DataFrame, checks: Sequence[Check], name: str = "_errors") -> DataFrame:
    """Rows with the list of rules they break, as ``rule:column``."""
    broken = [F.when(c.offending, F.lit(f"{c.rule}:{c.column}")) for c in checks if c.offending is not None]
    tags = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return df.withColumn(name, tags)


def null_profile(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Row count, null count and null ratio per column, in one aggregation."""
    def missing(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        nan = F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.lit(False)
        return c.isNull() | nan

    fields = df.schema.fields
    counts = df.agg(F.count(F.lit(1)).alias("rows"),
                    *[F.count_if(missing(f)).alias(f"n{i}") for i, f in enumerate(fields)])
    items = [F.struct(F.lit(f.name).alias("column"), F.col("rows").alias("rows"), F.col(f"n{i}").alias("nulls"))
             for i, f in enumerate(fields)]
    ratio = F.coalesce(F.try_divide("nulls", "rows"), F.lit(0.0))
    return (
        counts.select(F.explode(F.array(*items)).alias("x")).select("x.*")
        .withColumn("null_ratio", ratio)
        .withColumn("within_threshold", ratio <= threshold)
    )


def result_frame(spark: SparkSession, results: Sequence[tuple[str, ValidationResult]]) -> DataFrame:
    rows = [(stage, r.is_valid, r.errors, r.warnings, r.metadata) for stage, r in results]
    schema = T.StructType([T.StructField("stage", T.StringType()), *RESULT_SCHEMA.fields])
    return spark.createDataFrame(rows, schema)


def combine(results: Sequence[ValidationResult]) -> ValidationResult:
    """All must hold; errors of failed parts and all warnings are kept, metadata is not."""
    def add(total: ValidationResult, part: ValidationResult) -> ValidationResult:
        errors = total.errors + ([] if part.is_valid else part.errors)
        return ValidationResult(total.is_valid and part.is_valid, errors, total.warnings + part.warnings)

    return reduce(add, results, ValidationResult())
