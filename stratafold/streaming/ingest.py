"""Ingestion of raw files into bronze, by stream or by batch, with one state for both.

Bronze is a table with a folder for each dataset, date, run and batch.  A run writes its rows, then its part of the ledger (a row for each file:
kept or rejected), then one commit row.  Rows and ledger entries of runs without a commit are invisible, so a run that fails leaves nothing behind
that is read, and its files are taken by the next.  Files in the ledger are never taken again, whichever way they came, so a stream's replay or
an older checkpoint does no harm.  One run writes to a bronze table at a time.

A scan's files are all listed in the driver, so a dataset is listed and read in parts of ``files.PART_FILES`` files, one after another, along its
folders; what lies between listing and reading (names, sizes, parts) are tables.  A stream runs over the table of what was listed, to which each run
adds what it finds.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from .. import scratch
from ..sources.files import SCANS, file_parts, is_there, micro_batches, pending, read_files, read_table, scan_files, settings, write_table

DATASETS = ("matches", "timelines", "summoners", "ranked")
#: A listed file; ``part`` names the scan that found it.
LISTED = "dataset string, path string, length bigint, source_file string, part bigint"
_LEDGER = "dataset string, source_file string, path string, length bigint, file_hash string, batch int, reason string, run string"


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log table; an empty frame where nothing was written yet."""
    return spark.createDataFrame([], schema) if read_table(spark, path) is None else spark.read.schema(schema).parquet(path)


def commits(spark: SparkSession, bronze_path: str) -> DataFrame:
    """The runs that ended: run, files, bytes, rejected and time."""
    return _log(spark, f"{bronze_path}/_commits", "run string, files bigint, bytes bigint, rejected bigint, committed_at timestamp")


def ledger(spark: SparkSession, bronze_path: str) -> DataFrame:
    """A row for each file that was taken, with its batch and, if it was rejected, the reason."""
    done = commits(spark, bronze_path).select("run")
    return _log(spark, f"{bronze_path}/_ledger", _LEDGER).join(done, "run", "left_semi").select(*T._parse_datatype_string(_LEDGER).names)


def rejects(spark: SparkSession, bronze_path: str) -> DataFrame:
    """Files that were taken but have no row in :func:`read_bronze`: dataset, path, size, digest and reason."""
    return ledger(spark, bronze_path).where("reason is not null").select("dataset", "path", "length", "file_hash", "reason")


def read_bronze(spark: SparkSession, bronze_path: str, datasets: tuple[str, ...] | None = None) -> DataFrame | None:
    """The rows of committed runs; None where there is no bronze table.  A table that no run wrote is read as it is."""
    table = read_table(spark, bronze_path)
    if table is None:
        return None
    if "run" in table.columns:
        table = table.join(commits(spark, bronze_path).select("run"), "run", "left_semi").where("reason is null")
    return (table if datasets is None else table.where(F.col("dataset").isin(*datasets))).select(*S.BRONZE)


class _Scans:
    """Scans of the parts of datasets; that of a dataset which is one part is made once and serves for its list and its contents."""

    def __init__(self, spark: SparkSession, glob: str):
        self.spark, self.glob, self.parts, self.whole = spark, glob, {}, {}

    def of(self, part: int) -> DataFrame:
        return self.whole[part] if part in self.whole else scan_files(self.spark, self.parts[part], self.glob)

    def listed(self, raw_root: str, dataset: str, known: DataFrame | None = None) -> DataFrame:
        """The files of a dataset (see :data:`LISTED`) whose path ``known`` lacks; of more than one part, as a table that grows by part."""
        root, at = f"{raw_root}/{dataset}", scratch.fresh(self.spark, "listed")

        def rows(part: int) -> DataFrame:
            named = self.of(part).select(F.lit(dataset).alias("dataset"), "path", "length", _source_file(_root_name(raw_root)), F.lit(part).alias("part"))
            return named if known is None else named.join(known.select("path"), "path", "left_anti").select(*named.columns)

        for paths in file_parts(self.spark, root, self.glob):
            part = int.from_bytes(hashlib.sha256("\n".join(paths).encode()).digest()[:7])
            self.parts[part] = paths
            if paths == [root]:
                self.whole[part] = scan_files(self.spark, root, self.glob)
                return rows(part)
            rows(part).write.mode("append").parquet(at)
        return self.spark.read.schema(LISTED).parquet(at)


def _source_file(root: str) -> Column:
    return F.regexp_extract(F.url_decode("path"), rf"({root}/.*)$", 1).alias("source_file")


def _root_name(raw_root: str) -> str:
    return raw_root.rstrip("/").rsplit("/", 1)[-1]


def commit(files: DataFrame, scans: _Scans, bronze_path: str, root: str, max_files: int | dict[str, int], max_bytes: int | dict[str, int], out_files: int = 0) -> int:
    """Take those of ``files`` (see :data:`LISTED`) that the ledger lacks, as one run; the number of rows that bronze gains.

    Files are cut into greedy batches by ``micro_batches``; each batch is a folder of ``out_files`` files (0: as Spark deals them).  A file whose
    bytes are not UTF-8 goes to the ledger with its size, digest and reason.  Contents are read once, those of parts that hold such files; rows of a
    dataset in several parts are gathered in a table first, so that batches and their folders do not depend on parts."""
    spark, run = files.sparkSession, uuid.uuid4().hex
    fresh = files.join(ledger(spark, bronze_path).select("source_file"), "source_file", "left_anti")
    cut = scratch.saved(micro_batches(fresh, max_files, max_bytes).select("source_file", "dataset", "batch", "part"), "cut")
    found = {r["part"] for r in cut.select("part").distinct().collect()}
    old = ~F.col("part").isin(list(scans.parts))  # listed by a run that failed: in any part of now
    parts = [p for p in scans.parts if p in found or found - scans.parts.keys()]
    if not parts:
        scratch.discard(cut)
        return 0

    now = F.timestamp_micros(F.lit(spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]))

    def contents(part: int) -> DataFrame:
        own = cut.where((F.col("part") == part) | old).select("source_file", "dataset", "batch")
        return read_files(scans.of(part), root, now).drop("dataset").join(own, "source_file")

    gathered = None
    if scans.whole.keys() >= set(parts):
        rows = reduce(DataFrame.unionByName, map(contents, parts))
    else:
        gathered = scratch.fresh(spark, "contents")
        for part in parts:
            contents(part).write.mode("append").parquet(gathered)
        rows = spark.read.parquet(gathered)
    names = [*S.BRONZE, "path", "length", "reason", "run", "batch"]
    n = write_table(rows.withColumn("run", F.lit(run)).select(*names), bronze_path, partition_by=("dataset", "ingest_date", "run", "batch"), out_files=out_files)
    if gathered:
        scratch.delete(spark, gathered)
    scratch.discard(cut)
    if not n:
        return 0
    # The ledger is read from what was written, without the payloads.
    new = read_table(spark, bronze_path).where(F.col("run") == run)
    new = new.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(_LEDGER)])
    seen: dict = {}
    totals = (F.sum("length").alias("bytes"), F.count("reason").alias("rejected"))
    write_table(new, f"{bronze_path}/_ledger", observe=totals, observed=seen)
    done = spark.range(1).select(F.lit(run).alias("run"), F.lit(n).cast("long").alias("files"), F.lit(seen["bytes"]).cast("long").alias("bytes"), F.lit(seen["rejected"]).cast("long").alias("rejected"), F.current_timestamp().alias("committed_at"))
    done.coalesce(1).write.mode("append").parquet(f"{bronze_path}/_commits")
    return n - seen["rejected"]


def ingest(
    spark: SparkSession, raw_root: str, bronze_path: str, checkpoint: str, datasets: tuple[str, ...] = DATASETS, max_files: int | dict[str, int] = 100,
    max_bytes: int | dict[str, int] = 64 << 20, out_files: int = 0, glob: str = "*.json",
) -> list[StreamingQuery]:
    """Take the new files of each dataset whose folder is there by a stream that ends when there are none left.

    The checkpoint holds what was listed and how far the stream over it came; it only tells where to look, what is taken is decided by the ledger.
    Files that were listed but not taken, as a run failed, are handed over again.  Both bounds hold for every batch, as greedily as
    :func:`~stratafold.sources.files.micro_batches` cuts them; the stream itself hands over all new files at once, by name and size."""
    done = []
    for d in datasets:
        if not is_there(spark, f"{raw_root}/{d}"):
            continue
        scans, listed = _Scans(spark, glob), f"{checkpoint}/{d}/listed"
        known = read_table(spark, listed)

        def take(files: DataFrame, _: int, scans: _Scans = scans) -> None:
            with settings(files.sparkSession, SCANS):
                commit(files, scans, bronze_path, _root_name(raw_root), max_files, max_bytes, out_files)

        with settings(spark, SCANS):
            new = scans.listed(raw_root, d, known)
            if not new.isEmpty():
                new.write.mode("append").parquet(listed)
            at, fs = scratch._path(spark, listed)
            fs.mkdirs(at)
            source = spark.readStream.schema(LISTED).parquet(listed)
            query = source.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/{d}/stream").trigger(availableNow=True).start()
            query.awaitTermination()
        done.append(query)
    return done


def ingest_pending(
    spark: SparkSession, raw_root: str, bronze_path: str, datasets: tuple[str, ...] = DATASETS, max_files: int = 0, dataset_max: dict[str, int] | None = None,
    out_files: int = 0, batch_files: int | dict[str, int] | None = None, batch_bytes: int | dict[str, int] | None = None, glob: str = "*.json",
) -> int:
    """All files that the ledger lacks, as one run; the number of rows that bronze gains.

    ``max_files`` caps the run and ``dataset_max`` each dataset for its lifetime, as :func:`~stratafold.sources.files.pending` does; files are chosen by
    their names before contents are read.  Without ``batch_files`` and ``batch_bytes`` a dataset's files are one batch."""
    scans = _Scans(spark, glob)
    with settings(spark, SCANS):
        found = [scans.listed(raw_root, d) for d in datasets if is_there(spark, f"{raw_root}/{d}")]
        if not found:
            return 0
        chosen = pending(reduce(DataFrame.unionByName, found), ledger(spark, bronze_path), max_files, dataset_max)
        return commit(chosen, scans, bronze_path, _root_name(raw_root), batch_files or {}, batch_bytes or {}, out_files)


def dedup_events(events: DataFrame, keys: list[str], time: str, lateness: str = "10 minutes") -> DataFrame:
    """First arrival of each key on a stream, with state bounded by the watermark."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)
