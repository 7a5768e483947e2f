"""Helpers shared by the operators: scratch tables, Arrow maps, samples, blocks of large groups, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from ..scratch import saved

#: Rows of an Arrow batch where the session has Spark's default; one that the user chose stays.
ARROW_ROWS, _DEFAULT_ROWS, _ROWS_KEY = 1000, "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def discard(*tables: DataFrame | None) -> None:
    """Delete scratch tables that nothing reads any more: those :func:`saved` returned, and that no frame still to be run is made from."""
    scratch.discard(*[df for df in tables if df is not None and getattr(df, "_scratch", None)])


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one batch into batches.

    Spark bounds the bytes of a batch (``spark.sql.execution.arrow.maxBytesPerBatch``), so long texts come in small batches.  Batches of Spark's
    default number of rows leave workers with much memory, so a session that has this default gets ``ARROW_ROWS`` rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    if df.sparkSession.conf.get(_ROWS_KEY) == _DEFAULT_ROWS:
        df.sparkSession.conf.set(_ROWS_KEY, ARROW_ROWS)
    return df.mapInArrow(each, schema)


def annotated(docs: DataFrame, text_col: str, fn: Callable[..., list[pa.Array]], added: str, *more: Column) -> DataFrame:
    """``docs`` with the columns ``added`` (as DDL) that ``fn`` makes from a batch of texts and of the expressions ``more``.

    The rest of the caller's row travels as one struct, so no column of it can clash with those used here; a column of a name in
    ``added`` is replaced."""
    new = T._parse_datatype_string(added)
    rest = [c for c in docs.columns if c != text_col]
    frame = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("row"), F.col(f"`{text_col}`").alias("text"), *[m.alias(f"more{i}") for i, m in enumerate(more)]
    )
    schema = T.StructType([*frame.schema.fields[:2], *[T.StructField(f"new{i}", f.dataType) for i, f in enumerate(new)]])
    names, extra = schema.names, [f"more{i}" for i in range(len(more))]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = fn(batch["text"], *(batch[c] for c in extra))
        yield pa.RecordBatch.from_arrays([batch["row"], batch["text"], *made], names)

    old = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in new.names]
    return map_arrow(frame, run, schema).select(*old, *[F.col(f"new{i}").alias(c) for i, c in enumerate(new.names)])


def bounded_sample(rows: DataFrame, salt: Column, most: int) -> DataFrame:
    """Rows of the smallest ``salt`` (a hash, so uniform), at most ``most`` and nearly so many; the same ones in every run.

    Only counts travel: the share of salts that holds about twice the sample is cut into ranges, and ranges are taken in order while
    they fit.  A range that a much repeated salt overfills is passed over; if none fits, ``most`` rows of the first are taken."""
    n = rows.count()
    if n <= most:
        return rows
    place = F.shiftrightunsigned(salt, 1) / F.lit(float(1 << 63))  # 0 to 1
    part = F.floor(place * F.lit(64.0 * n / most)).cast("long")
    sizes = rows.where(part < 128).groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    taken, left = [], most
    for r in sizes:
        if r["n"] <= left:
            taken.append(r["part"])
            left -= r["n"]
    return rows.where(part.isin(taken)) if taken else rows.where(part == sizes[0]["part"] if sizes else F.lit(True)).limit(most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def block_pairs(df: DataFrame, key: str, size: str, salt: str, limit: int) -> DataFrame:
    """Deal the rows of each key into blocks so that every pair of rows of a key meets in exactly one block.

    A key with at most ``limit`` rows (``size`` holds the count) is one block.  A larger one is cut into chunks by the
    hash of ``salt``; there is a block for each pair of chunks.  Adds ``block_i``, ``block_j`` and ``chunk``: within
    a block with i < j only pairs between the chunks count.
    """
    chunks = F.ceil(F.col(size) / limit).cast("int")
    chunk = F.pmod(F.xxhash64(salt), chunks.cast("long")).cast("int")
    out = df.withColumn("chunk", chunk).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return out.withColumns(
        {"block_i": F.least("chunk", "_other"), "block_j": F.greatest("chunk", "_other")}
    ).drop("_other")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (u, v): one row per node, ``node`` and ``root``, its
    component's smallest node.  Large-star and small-star rounds (Kiveris et al. 2014); each round is saved."""
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if not mark["n"] or (mark["n"], mark["h"]) == state:
            break
        state = (mark["n"], mark["h"])
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Least neighbours are saved, so that Spark can split a node of many edges in the joins.
        near = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "cc-near")
        large = e.join(near.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v")).distinct()
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        last, e = e, saved(small.select("e.u", "e.v").where("u <> v").distinct(), "cc")
        discard(last, near, least)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
