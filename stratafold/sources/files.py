"""Raw JSON files to bronze rows, in batch; tables in and out."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from .. import scratch
from ..functions import exprs as X


#: Files of one scan, as far as folders allow: a scan keeps its whole list of files in the driver, some 2 kB each.
PART_FILES = 40_000
#: Settings for scans of many small files: a file costs a task 128 kB beside its own bytes (Spark's 4 MB make a task for every 32 files), lists of
#: files that were scanned are not kept, and folders are listed by tasks, in 128 of them at most (Spark: one for each folder, up to 10,000).
_DISCOVERY = "spark.sql.sources.parallelPartitionDiscovery"
SCANS = {"spark.sql.files.openCostInBytes": 128 << 10, "spark.sql.hive.filesourcePartitionFileCacheSize": 0, f"{_DISCOVERY}.threshold": 4, f"{_DISCOVERY}.parallelism": 128}


def scan_files(spark: SparkSession, root: str | list[str], glob: str = "*.json", recursive: bool = True) -> DataFrame:
    """Path, content, size and modification time of the files below ``root`` (or several)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(root)


def is_there(spark: SparkSession, root: str) -> bool:
    """Whether a folder (or one that a pattern names) is there; its files are not listed."""
    at, fs = scratch._path(spark, root)
    found = fs.globStatus(at)
    return found is not None and len(found) > 0


@contextmanager
def settings(spark: SparkSession, values: dict) -> Iterator[None]:
    """Settings of the session while scans are planned and run; its own come back."""
    old = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def file_parts(spark: SparkSession, root: str, glob: str = "*.json", most: int | None = None) -> Iterator[list[str]]:
    """``root`` cut at its folders into parts of at most ``most`` (:data:`PART_FILES`) files, each the paths of one scan: ``[root]`` if that is
    enough.  A folder that holds more files itself is one part.  The file system counts the files, no list of all is made."""
    most = PART_FILES if most is None else most
    at, fs = scratch._path(spark, root)

    def plain(path) -> str:
        return re.sub(r"([\\{}\[\]*?])", r"\\\1", path.toString())  # scans take patterns

    def seen(status) -> bool:
        name = status.getPath().getName()
        return not (name.startswith(".") or name.startswith("_") and "=" not in name)  # as scans do

    def counted(paths: list) -> list[tuple]:
        """Each path, its files, and whether there are folders below."""
        with ThreadPoolExecutor(8) as pool:
            return [(p, c.getFileCount(), c.getDirectoryCount() > 1) for p, c in zip(paths, pool.map(fs.getContentSummary, paths), strict=True)]

    def below(path) -> list[tuple]:
        """The folders in a folder, counted, and the files beside them as one entry, which is not cut (None)."""
        inside = fs.listStatus(path)
        folders = [s.getPath() for s in inside if s.isDirectory() and seen(s)]
        return [*counted(folders), (path, len(inside) - len(folders), None)]

    def cut(path, n: int, folders: bool | None) -> Iterator[tuple[str, int]]:
        if folders is None:
            beside = fs.globStatus(scratch._path(spark, f"{plain(path)}/{glob}")[0]) if n else ()
            yield from ((plain(s.getPath()), 1) for s in beside if not s.isDirectory() and seen(s))
        elif n <= most or not folders:
            yield plain(path), n
        else:
            for tree in below(path):
                yield from cut(*tree)

    trees = []
    for s in fs.globStatus(at) or ():  # folders of a few entries are not counted themselves, those in them are
        few = s.isDirectory() and len(fs.listStatus(s.getPath())) <= 1000
        trees += below(s.getPath()) if few else counted([s.getPath()])
    if sum(n for _, n, _ in trees) <= most:
        yield [root]
        return
    part, size = [], 0
    for path, n in (x for tree in trees for x in cut(*tree)):
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(path)
        size += n
    yield part or [root]


def micro_batches(files: DataFrame, max_files: int | dict[str, int], max_bytes: int | dict[str, int]) -> DataFrame:
    """``files`` (dataset, path, length) with ``batch``, from 0 in each dataset: greedy batches in order of path.

    A batch takes files until it has ``max_files`` of them or the next would pass ``max_bytes``; a larger file goes alone.  The bounds are numbers
    or one for each dataset (missing: none).  Where a batch starts is only known from the one before it, so starts are found by pointer
    jumping: each file knows where the batch after its own would start, were it the first; jumps of 1, 2, 4, ... batches lead from the first file to
    all starts, in as many joins as the number of batches has binary digits.  The windows run over a dataset's listing: names and sizes only."""
    spark = files.sparkSession

    def bound(of: int | dict[str, int]) -> Column:
        if isinstance(of, dict):
            known = F.create_map(*[F.lit(x) for k, v in of.items() for x in (k, v)])[F.col("dataset")] if of else F.lit(None)
            return F.coalesce(known.cast("long"), F.lit((1 << 62) - 1))
        return F.lit(of).cast("long")

    def over(*order: Column | str) -> Window:
        return Window.partitionBy("dataset").orderBy(*order)

    placed = files.withColumns({"_at": F.row_number().over(over("path")) - 1, "_end": F.sum("length").over(over("path").rowsBetween(Window.unboundedPreceding, 0))})
    placed = scratch.saved(placed, "batches")
    # Files that end within the bytes from a file's start: ends and bounds in one order, ends counted.
    ends = placed.select("dataset", F.col("_end").alias("x"), F.lit(0).alias("_at"), F.lit(1).alias("end"))
    asks = placed.select("dataset", (F.col("_end") - F.col("length") + bound(max_bytes)).alias("x"), "_at", F.lit(0).alias("end"))
    within = F.sum("end").over(over("x", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0))
    reach = ends.unionAll(asks).withColumn("within", within).where("end = 0")
    to = F.greatest(F.least(F.col("within"), F.col("_at") + bound(max_files)), F.col("_at") + 1)
    jump = scratch.saved(reach.select("dataset", "_at", to.alias("to")), "jumps")
    starts, turn = placed.where("_at = 0").select("dataset", "_at"), 0
    while True:
        further = starts.join(jump, ["dataset", "_at"]).select("dataset", F.col("to").alias("_at"))
        inside = further.join(placed.select("dataset", "_at"), ["dataset", "_at"], "left_semi")
        grown = scratch.saved(starts.unionAll(inside), "starts")
        done, last = grown.count() == starts.count(), starts
        starts = grown
        if turn:
            scratch.discard(last)
        if done:
            break
        turn += 1
        ahead = jump.select("dataset", F.col("_at").alias("to"), F.col("to").alias("_next"))
        longer = scratch.saved(jump.join(ahead, ["dataset", "to"]).select("dataset", "_at", F.col("_next").alias("to")), "jumps")
        scratch.discard(jump)
        jump = longer
    marked = placed.join(starts.withColumn("_first", F.lit(1)), ["dataset", "_at"], "left")
    nth = F.count("_first").over(over("_at").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return marked.withColumn("batch", nth.cast("int")).select(*files.columns, "batch")


def read_files(files: DataFrame, root_name: str = "raw", ingest_time: Column | None = None, from_payload: bool = False) -> DataFrame:
    """Bronze columns of all scanned files, with ``path``, ``length`` and ``reason``: null, or why the file has no payload (it is not UTF-8).

    Malformed JSON is kept as it is.  ``ingest_time`` defaults to now; pass ``col('modificationTime')`` to date files by their own time."""
    when = F.current_timestamp() if ingest_time is None else ingest_time
    path, text = F.url_decode("path"), F.col("content").cast("string")
    good = F.is_valid_utf8(text)
    rows = files.select(
        path.alias("path"), "length", F.regexp_extract(path, rf"({root_name}/.*)$", 1).alias("source_file"), F.sha2("content", 256).alias("file_hash"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ingest_ts"), F.date_format(when, "yyyy-MM-dd").alias("ingest_date"),
        F.when(good, text).alias("payload_json"), F.when(~good, F.lit("not UTF-8")).alias("reason"),
    )
    return rows.withColumn("dataset", X.detect_dataset("path", "payload_json" if from_payload else None)).select(*S.BRONZE, "path", "length", "reason")


def bronze_rows(files: DataFrame, root_name: str = "raw", ingest_time: Column | None = None, from_payload: bool = False) -> DataFrame:
    """Bronze columns of the scanned files that are UTF-8, as :func:`read_files` reads them."""
    return read_files(files, root_name, ingest_time, from_payload).where("reason is null").select(*S.BRONZE)


def rejected(files: DataFrame, root_name: str = "raw") -> DataFrame:
    """Path, size, digest and reason of the scanned files that :func:`bronze_rows` leaves out."""
    return read_files(files, root_name).where("reason is not null").select("path", "length", "file_hash", "reason")


def manifest(files: DataFrame, root_name: str = "raw") -> DataFrame:
    """Bronze rows without payloads."""
    return bronze_rows(files, root_name).drop("payload_json")


def pending(rows: DataFrame, bronze: DataFrame | None, max_files: int = 0, dataset_max: dict[str, int] | None = None) -> DataFrame:
    """Rows whose file is not in bronze yet: at most ``max_files`` (0: all), and within each dataset's lifetime cap."""
    fresh = rows if bronze is None else rows.join(bronze.select("source_file"), "source_file", "left_anti")
    if dataset_max:
        done = bronze.groupBy("dataset").agg(F.count("*").alias("done")) if bronze is not None else None
        cap = F.create_map(*[F.lit(x) for k, v in dataset_max.items() for x in (k, v)])[F.col("dataset")]
        nth = F.row_number().over(Window.partitionBy("dataset").orderBy("source_file"))
        fresh = fresh.withColumn("_n", nth)
        fresh = fresh.withColumn("done", F.lit(0)) if done is None else fresh.join(F.broadcast(done), "dataset", "left")  # one row for each dataset
        fresh = fresh.where(cap.isNull() | (F.col("_n") <= cap - F.coalesce("done", F.lit(0)))).drop("_n", "done")
    return (fresh.orderBy("dataset", "source_file").limit(max_files) if max_files else fresh).select(*rows.columns)


_INFERENCE = "spark.sql.sources.partitionColumnTypeInference.enabled"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None where there is none.  Partition columns stay text, as dates are; the session's settings stay too."""
    old = spark.conf.get(_INFERENCE)
    spark.conf.set(_INFERENCE, "false")  # folders are listed and typed within load()
    try:
        df = spark.read.format(fmt).load(path)
        return df if df.columns else None
    except AnalysisException:
        return None
    finally:
        spark.conf.set(_INFERENCE, old)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", partition_by: tuple[str, ...] = (), write_empty: bool = False, out_files: int = 0,
    max_rows: int = 0, observe: tuple[Column, ...] = (), observed: dict | None = None, dates: bool = False,
) -> int:
    """Write ``df``, partitioned by those of ``partition_by`` it has; returns the number of rows, counted by the write itself.

    Without ``write_empty`` an empty frame leaves the table as it is: the frame is written beside the table and moved into its place.  Rows of a
    partition are brought together first (AQE splits large ones), so files are few; ``out_files`` asks for that many files in each partition instead
    (fewer only where it has fewer rows), ``max_rows`` bounds the rows of a file.  ``observe`` are further aggregates of the written rows, put into
    ``observed`` by name.  With ``dates`` an overwrite replaces only the partitions that ``df`` has rows for."""
    if mode not in ("append", "overwrite", "ignore", "error", "errorifexists"):
        raise ValueError(f"unknown write mode: {mode}")
    spark, there = df.sparkSession, scratch.exists(df.sparkSession, path)
    if there and mode == "ignore":
        return 0
    if there and mode.startswith("error"):
        raise ValueError(f"{path} is there")
    parts = [c for c in partition_by if c in df.columns]
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"), *observe)
    if out_files:
        out = out.repartition(out_files)
    elif parts:
        out = out.hint("rebalance", *parts)
    at = path if there and (mode == "append" or dates) else f"{scratch.beside(path)}-new-{uuid.uuid4().hex}"
    writer = out.write.format(fmt).mode("overwrite" if dates and there and mode == "overwrite" else "append").partitionBy(*parts)
    writer = writer.option("maxRecordsPerFile", max_rows) if max_rows else writer
    writer.option("partitionOverwriteMode", "dynamic").save(at)
    values = _metrics(seen)
    if observed is not None:
        observed.update(values)
    n = values.get("n", 0)
    if at != path:
        if n or write_empty:
            scratch.replace(spark, at, path)
        else:
            scratch.delete(spark, at)
    return n


def _metrics(seen: Observation) -> dict:
    """The observed values; none where Spark found while running that the frame is empty and left the plan, observation and all, away."""
    try:
        return seen.get
    except Py4JJavaError as e:
        if "assertion failed" in str(e.java_exception):
            return {}
        raise


def catalogue_difference(spark: SparkSession, root: str, layer: str, tables: list[str], database: str = "default", fmt: str = "parquet") -> dict[str, dict]:
    """For each of the layer's tables that is there on disk, under its catalogue name ``<layer>_<table>``: ``action`` (create, extend, keep, or
    conflict), ``location``, ``added`` columns and, for a conflict, ``why``.  Nothing is changed."""
    out = {}
    for t in tables:
        found, name = read_table(spark, f"{root}/{layer}/{t}", fmt), f"{layer}_{t}"
        if found is None:
            continue
        own = {"action": "create", "location": _qualified(spark, f"{root}/{layer}/{t}"), "added": [], "schema": found.schema}
        if spark.catalog.tableExists(f"`{database}`.`{name}`"):
            about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{name}`").collect()}
            known = {f.name: f.dataType for f in spark.table(f"`{database}`.`{name}`").schema}
            changed = [f.name for f in found.schema if f.name in known and known[f.name] != f.dataType]
            own["added"] = [f for f in found.schema if f.name not in known]
            if about.get("Type") != "EXTERNAL":
                own |= {"action": "conflict", "why": f"a {about.get('Type', 'view').lower()} table has this name"}
            elif _qualified(spark, about.get("Location", "")) != own["location"]:
                own |= {"action": "conflict", "why": f"the table of this name lies at {about.get('Location')}"}
            elif changed:
                own |= {"action": "conflict", "why": f"columns of another type: {', '.join(changed)}"}
            else:
                own["action"] = "extend" if own["added"] else "keep"
        out[name] = own
    return out


def _qualified(spark: SparkSession, path: str) -> str:
    at, fs = scratch._path(spark, path)
    return fs.makeQualified(at).toString() if path else ""


def register_tables(spark: SparkSession, root: str, layer: str, tables: list[str], database: str = "default", fmt: str = "parquet") -> dict[str, str]:
    """External tables ``<database>.<layer>_<table>`` over ``root/layer/table``; what was done for each that is there on disk.

    The database is made if it is not there.  Tables that are registered already are kept, new columns added to them, and their partitions found
    again.  Nothing is dropped: if any name is taken by a managed table, a view, a table elsewhere or one with other types, an error names it and
    nothing is changed."""
    todo = catalogue_difference(spark, root, layer, tables, database, fmt)
    if bad := [f"{name}: {x['why']}" for name, x in todo.items() if x["action"] == "conflict"]:
        raise ValueError(f"cannot register in {database}: {'; '.join(bad)}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, x in todo.items():
        full = f"`{database}`.`{name}`"
        if x["action"] == "create":
            folders = [c for c in read_partitions(spark, x["location"], fmt) if c in x["schema"].names]
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x["schema"])
            split = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in folders)})" if folders else ""
            spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({columns}) USING {fmt} {split} LOCATION '{x['location']}'")
        elif x["added"]:
            spark.sql(f"ALTER TABLE {full} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in x['added'])})")
        if spark.sql(f"DESCRIBE TABLE {full}").where("col_name = '# Partition Information'").count():
            spark.sql(f"MSCK REPAIR TABLE {full} SYNC PARTITIONS")
        spark.catalog.refreshTable(full)
    return {name: x["action"] for name, x in todo.items()}


def read_partitions(spark: SparkSession, path: str, fmt: str = "parquet") -> list[str]:
    """Names of the partition columns of the table at ``path``: those of its first file's folders."""
    df = read_table(spark, path, fmt)
    first = df.select(F.input_file_name().alias("f")).limit(1).collect() if df is not None else []
    below = first[0]["f"].split(path.rstrip("/").rpartition("/")[2] + "/", 1)[-1] if first else ""
    return [x.split("=", 1)[0] for x in below.split("/")[:-1] if "=" in x]
