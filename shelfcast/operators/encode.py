"""Categorical encoding and scaling. ``fit`` functions return small serialisable dataclasses."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.numeric import numeric_columns, string_columns
from shelfcast.operators.skew import broadcast_if_small
from shelfcast.session import materialise

UNKNOWN = "unknown"
# One output column per category: wide frames beyond this should use label codes instead.
MAX_CATEGORIES = 1000


def quoted(name: str) -> Column:
    """A column by its name, which may hold dots or quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """String columns other than group keys and the date."""
    return [c for c in string_columns(df) if c not in exclude]


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, value) pairs of several columns in one pass, combined before the shuffle."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns
    ]))
    return df.select(pairs.alias("p")).select("p.*").distinct()


@dataclass(frozen=True)
class OneHot:
    """Sorted categories per column; None stands for a missing value and sorts last."""

    categories: dict[str, list[str | None]]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES) -> OneHot:
        if not columns:
            return OneHot({})
        found = materialise(distinct_values(df, columns))
        wide = found.groupBy("column").count().filter(F.col("count") > max_categories).first()
        if wide:
            raise ValueError(
                f"Column {wide['column']} has {wide['count']} categories; encode it with SparseOneHot or LabelCodes"
            )
        values: dict[str, list[str | None]] = {c: [] for c in columns}
        # At most max_categories values per column reach the driver.
        for row in found.collect():
            values[row["column"]].append(row["value"])
        return OneHot({c: sorted(v, key=lambda x: (x is None, x or "")) for c, v in values.items()})

    def outputs(self) -> list[tuple[str, str | None, str]]:
        """Column, category and name of each indicator; a missing value beside the text ``None`` is told apart."""
        found: list[tuple[str, str | None, str]] = []
        taken: set[str] = set()
        for c, values in self.categories.items():
            for v in values:
                name = f"{c}_{v}"
                while name.lower() in taken:
                    name += "_missing" if v is None else "_"
                taken.add(name.lower())
                found.append((c, v, name))
        return found

    def names(self) -> list[str]:
        return [name for _, _, name in self.outputs()]

    def transform(self, df: DataFrame) -> DataFrame:
        """One 0/1 column per category, in place of the original; unseen values give all zeros."""
        def indicator(c: str, v: str | None, name: str) -> Column:
            same = quoted(c).isNull() if v is None else quoted(c) == F.lit(v)
            return F.when(same, 1.0).otherwise(0.0).alias(name)

        kept = [quoted(c) for c in df.columns if c not in self.categories]
        return df.select(*kept, *[indicator(*x) for x in self.outputs()])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> OneHot:
        return OneHot(**json.loads(text))


@dataclass(frozen=True)
class StandardScale:
    """Mean and population deviation per column; a constant column is only centred."""

    moments: dict[str, tuple[float | None, float | None]]

    @staticmethod
    def fit(df: DataFrame, exclude: Sequence[str] = (), columns_per_scan: int | None = None) -> StandardScale:
        """All numeric columns but ``exclude`` in one aggregation; nulls are skipped.

        For a stored table, ``columns_per_scan`` splits a wide aggregation into narrow ones in the same
        job, each reading only its own columns.
        """
        columns = [c for c in numeric_columns(df) if c not in exclude]
        if not columns:
            return StandardScale({})
        width = columns_per_scan or len(columns)

        def moments(part: list[str]) -> DataFrame:
            rows = [F.struct(F.lit(c).alias("column"), F.avg(quoted(c)).cast("double").alias("mean"),
                             F.stddev_pop(quoted(c)).alias("deviation")) for c in part]
            return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")

        scans = [moments(columns[i: i + width]) for i in range(0, len(columns), width)]
        found = {r["column"]: (r["mean"], r["deviation"]) for r in reduce(DataFrame.unionAll, scans).collect()}
        return StandardScale({c: found[c] for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(c: str) -> Column:
            mean, deviation = self.moments[c]
            if mean is None:
                return F.lit(None).cast("double").alias(c)
            return ((quoted(c) - F.lit(mean)) / F.lit(deviation or 1.0)).alias(c)

        return df.select(*[scaled(c) if c in self.moments else quoted(c) for c in df.columns])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> StandardScale:
        return StandardScale({c: tuple(m) for c, m in json.loads(text)["moments"].items()})


@dataclass(frozen=True)
class LabelCodes:
    """Dictionary table ``(column, value, code)``; codes follow the sorted values."""

    table: DataFrame
    columns: tuple[str, ...]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> LabelCodes:
        from shelfcast.operators.skew import row_positions

        filled = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in columns])
        ranked = row_positions(distinct_values(filled, columns), ["column"], ["value"])
        return LabelCodes(ranked.select("column", "value", F.col("_pos").cast("int").alias("code")),
                          tuple(columns))

    def transform(self, df: DataFrame) -> DataFrame:
        """Codes in place of the strings; an unseen value gets 0, a string without codes is dropped."""
        unknown = [c for c in string_columns(df) if c not in self.columns]
        out = df.drop(*unknown)
        table = materialise(self.table)
        rows = table.count()
        for c in [c for c in self.columns if c in df.columns]:
            codes = table.filter(F.col("column") == c).select(
                F.col("value").alias("_value"), F.col("code").alias("_code"))
            key = F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
            out = out.join(broadcast_if_small(codes, rows), key == F.col("_value"), "left")
            out = out.withColumn(c, F.coalesce("_code", F.lit(0))).drop("_value", "_code")
        return out.select(*[c for c in df.columns if c not in unknown])


@dataclass(frozen=True)
class SparseOneHot:
    """Dictionary table ``(column, value, index)`` of any number of categories, one index for each.

    Columns follow each other in the given order, each with its sorted values, a missing value last. The
    dictionary is a table from its fit on: it is neither collected nor broadcast beyond a measured size.
    """

    table: DataFrame
    columns: tuple[str, ...]
    size: int

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> SparseOneHot:
        from shelfcast.operators.skew import row_positions

        found = distinct_values(df, columns).withColumn("missing", F.col("value").isNull())
        ranked = row_positions(found, ["column"], ["missing", "value"])
        sizes = {r["column"]: r["n"] for r in ranked.groupBy("column").agg(
            F.count(F.lit(1)).alias("n")).collect()}  # one row per column
        first, firsts = 0, []
        for c in columns:
            firsts.append(F.when(F.col("column") == c, F.lit(first)))
            first += sizes.get(c, 0)
        index = (F.col("_pos") + F.coalesce(*firsts)).cast("int")
        return SparseOneHot(materialise(ranked.select("column", "value", index.alias("index"))), tuple(columns), first)

    def transform(self, df: DataFrame, prefix: str = "one_hot") -> DataFrame:
        """Two columns in place of the encoded ones: ``<prefix>_indices``, ascending, and ``<prefix>_values``.

        A row has one index per encoded column; values that the fit has not seen have none.
        """
        rows, out, places = self.table.count(), df, []
        for i, c in enumerate(c for c in self.columns if c in df.columns):
            codes = self.table.filter(F.col("column") == c).select(
                F.col("value").alias(f"_value{i}"), F.col("index").alias(f"_index{i}"))
            out = out.join(broadcast_if_small(codes, rows), quoted(c).cast("string").eqNullSafe(F.col(f"_value{i}")), "left")
            places.append(F.col(f"_index{i}"))
        indices = F.array_sort(F.array_compact(F.array(*places))) if places else F.array().cast("array<int>")
        kept = [quoted(c) for c in df.columns if c not in self.columns]
        return out.select(*kept, indices.alias(f"{prefix}_indices"),
                          F.transform(indices, lambda _: F.lit(1.0)).alias(f"{prefix}_values"))

    def vectors(self, df: DataFrame, name: str = "one_hot") -> DataFrame:
        """The same as one sparse vector column for MLlib, a block of the vector per encoded column."""
        coded = self.transform(df, name)
        size = self.size

        @F.udf(VectorUDT())
        def sparse(indices, values):
            return SparseVector(size, indices, values)

        return coded.withColumn(name, sparse(f"{name}_indices", f"{name}_values")).drop(
            f"{name}_indices", f"{name}_values")

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, columns: Sequence[str]) -> SparseOneHot:
        table = spark.read.parquet(path)
        return SparseOneHot(table, tuple(columns), (table.agg(F.max("index")).first()[0] or -1) + 1)


def split_by_width(
    df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES
) -> tuple[list[str], list[str]]:
    """Columns of few categories, which get an indicator each, and wide ones, for a sparse encoding."""
    if not columns:
        return [], []
    sizes = {r["column"]: r["count"] for r in distinct_values(df, columns).groupBy("column").count().collect()}
    wide = [c for c in columns if sizes.get(c, 0) > max_categories]
    return [c for c in columns if c not in wide], wide


def prepare_matrix(df: DataFrame, date_col: str = "date", codes: LabelCodes | None = None) -> DataFrame:
    """Drop the date, encode strings if codes are given, keep numbers, fill gaps with 0."""
    plain = df.drop(date_col)
    if codes is not None:
        plain = codes.transform(plain)
    return plain.select(*[F.coalesce(quoted(c), F.lit(0)).cast(plain.schema[c].dataType).alias(c)
                          for c in numeric_columns(plain)])


def align_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns`` in that order: absent ones are 0, others are dropped."""
    return df.select(*[quoted(c) if c in df.columns else F.lit(0).alias(c) for c in columns])
