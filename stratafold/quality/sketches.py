"""Profiles that can be kept by day and merged: counts, bounds, sums and a sketch of the distinct values of each column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import read_table, write_table

#: Size of a sketch, as a power of two of its buckets: a relative error of about 1.04 / sqrt(2 ** 12), 1.6 %.
LG_K = 12
SCHEMA = "table string, column string, type string, n bigint, nulls bigint, empty_strings bigint, min_value double, max_value double, sum double, known bigint, sketch binary, date string"


def daily(df: DataFrame, table: str, date: str = "game_date") -> DataFrame:
    """One row for each column and date of ``df`` (``SCHEMA``); a null date is a date."""
    aggs, rows = [F.count(F.lit(1)).alias("_n")], []
    for i, f in enumerate(df.schema):
        c, number, text = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType), isinstance(f.dataType, T.StringType)
        direct = isinstance(f.dataType, (T.StringType, T.LongType, T.IntegerType, T.BinaryType))
        aggs += [F.count(c).alias(f"k{i}"), F.hll_sketch_agg(c if direct else c.cast("string"), F.lit(LG_K)).alias(f"s{i}")]
        aggs += [F.count_if(F.trim(c) == "").alias(f"e{i}")] if text else []
        aggs += [fn(c).cast("double").alias(f"{k}{i}") for k, fn in (("lo", F.min), ("hi", F.max), ("su", F.sum))] if number else []
        of = lambda k, i=i: F.col(f"{k}{i}") if number else F.lit(None).cast("double")  # noqa: E731,B023
        empty = F.col(f"e{i}") if text else F.lit(0).cast("long")
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_n").alias("n"), (F.col("_n") - F.col(f"k{i}")).alias("nulls"), empty.alias("empty_strings"),
                of("lo").alias("min_value"), of("hi").alias("max_value"), of("su").alias("sum"), F.col(f"k{i}").alias("known"), F.col(f"s{i}").alias("sketch"),
            )
        )
    by = df.groupBy(F.col(date).cast("string").alias("_date")).agg(*aggs)
    return by.select("_date", F.explode(F.array(*rows)).alias("x")).select(F.lit(table).alias("table"), "x.*", F.col("_date").alias("date"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Profiles of the days in ``sketches`` together, by table, column and further columns: the columns of ``report.profile`` and ``rows``.

    Distinct values are estimates; all else is exact."""
    total = F.sum("known")
    out = sketches.groupBy("table", "column", "type", *by).agg(
        F.sum("n").alias("rows"), F.sum("nulls").alias("nulls"), F.coalesce(F.round(F.try_divide(F.sum("nulls"), F.sum("n")), 6), F.lit(0.0)).alias("null_ratio"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"), F.sum("empty_strings").alias("empty_strings"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.try_divide(F.sum("sum"), total).alias("avg_value"),
    )
    return out


def refresh(df: DataFrame, table: str, store: str, dates: list[str] | None = None, date: str = "game_date") -> None:
    """Bring the stored sketches of ``table`` up to date: those of ``dates`` (None: all) are made anew, and no other day is read.

    The store is partitioned by table and date; days that lost all their rows must be given with the table that still has the others."""
    rows = df if dates is None else df.where(F.col(date).isin(dates))
    write_table(daily(rows, table, date), store, mode="overwrite", partition_by=("table", "date"), dates=True)


def read(spark: SparkSession, store: str) -> DataFrame | None:
    """The stored sketches; None where there are none."""
    return None if read_table(spark, store) is None else spark.read.schema(SCHEMA).parquet(store)
