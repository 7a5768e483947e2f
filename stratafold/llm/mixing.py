"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source serves its documents in shuffled order, pass after pass; a document's virtual finish time is the number of its
source's tokens served up to its end, divided by the source's target.  Served in order of finish time, all sources
stay in proportion to their targets at every moment; the mix ends where the total budget is reached.  There a
document in service is cut at its share, so each source lands on its target.

Scale: running sums are made in two levels.  Documents fall into cells by (source, hash bucket); the sums of cells form
a small table that is accumulated per source, and rows are accumulated inside their cell.  A source with a third of
all rows is spread over all buckets.  Rows equal in id and text share a hash; if they alone overfill a cell, they are dealt over
cells of their own by their place in the stored table.  The final order is a range sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Rows meant for one cell of the running sums.
CELL_ROWS = 10_000
_CELL = ["src", "bucket", "hot", "share"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of each source: ``sizes`` (source, source_size) by weight from a budget of ``share`` times all sizes,
    none above ``most`` times its size, the excess shared anew by weight.

    Water filling in closed form: sources are capped in order of ``most * size / weight``, and the level for the rest is
    what remains divided by their weight.  One window over one row per source."""
    null_last = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    everything = Window.partitionBy()
    w = sizes.withColumn("rank", F.row_number().over(everything.orderBy(*null_last)) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    w = w.withColumns({"cap": most * F.col("source_size"), "budget": share * F.sum("source_size").over(everything)})
    w = w.withColumn("fullness", F.col("cap") / F.col("weight"))
    upto = everything.orderBy("fullness", "rank").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"capped": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), "done": F.coalesce(F.sum("weight").over(upto), F.lit(0.0)), "all": F.sum("weight").over(everything)})
    level = (F.col("budget") - F.col("capped")) / (F.col("all") - F.col("done"))
    # The level is reached at the first source that does not fill up.
    w = w.withColumn("level", level).withColumn("first", F.when(F.col("level") < F.col("fullness"), F.struct("fullness", "rank", "level")))
    w = w.withColumn("stop", F.min("first").over(everything))
    return w.select(*sizes.columns, F.when(F.col("stop").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("stop.level"))).alias("target"))


def _repeated(few: DataFrame, bucket: Column, cell_rows: int) -> DataFrame:
    """Hashes of more than ``cell_rows`` rows of a source, with their number; only cells of more than twice as many are looked into."""
    few = few.select("src", "h", bucket.alias("bucket"))
    full = few.groupBy("src", "bucket").count().where(F.col("count") > 2 * cell_rows)
    return saved(few.join(full, ["src", "bucket"], "leftsemi").groupBy("src", "h").count().where(F.col("count") > cell_rows), "mix-repeated")


def _cells(frame: DataFrame, bucket: Column, repeated: DataFrame, cell_rows: int) -> DataFrame:
    """Adds the cell of each row: its bucket, and for rows of a ``repeated`` hash that hash and a share of ``cell_rows`` rows or so, from 1."""
    if repeated.isEmpty():
        return frame.withColumns({"bucket": bucket, "hot": F.lit(0).cast("long"), "share": F.lit(0).cast("long")})
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    marked = frame.withColumns({"bucket": bucket, "place": place}).join(repeated, ["src", "h"], "left")
    hot = F.col("count").isNotNull()
    share = 1 + F.pmod("place", F.ceil(F.col("count") / cell_rows))
    return marked.withColumns({"hot": F.when(hot, F.col("h")).otherwise(0), "share": F.when(hot, share).otherwise(0)}).drop("place", "count")


def serve(
    docs: DataFrame, keep: list[str], text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = 17,
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, store: bool = True, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The columns ``keep`` of each row with ``size``, ``source_size``, ``target``, ``taken`` and ``finish``.

    With ``store`` the sized rows are written once and read twice; without, word counts are made twice, which suits a
    caller that keeps the texts.  ``cell_rows``: rows meant for one cell of the running sums, however often a row is repeated."""
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    rows = docs.select(
        *[F.col(c).alias(f"k_{c}") for c in keep], key.alias("src"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    )
    rows = saved(rows, "mix-sizes") if store else rows
    # Buckets in hash order, so that sums of buckets and of rows within a bucket form one running sum.
    few = saved(rows.select("src", "source", "size", "h"), "mix-rows") if not store else rows
    buckets = max(1, few.count() // cell_rows)
    width = (1 << 40) // buckets + 1
    bucket = F.floor(F.shiftrightunsigned("h", 24) / F.lit(width))
    repeated = _repeated(few, bucket, cell_rows)
    if store or repeated.isEmpty():
        rows, few = (_cells(f, bucket, repeated, cell_rows) for f in (rows, few))
    else:
        # Equal rows are told apart by their place, so both readings must be of one stored table.
        rows = few = _cells(saved(rows, "mix-texts"), bucket, repeated, cell_rows)
    aims = targets(few.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").cast("double").alias("source_size")), weights, share, float(most))
    cells = few.groupBy(*_CELL).agg(F.sum("size").alias("cell"))
    upto = Window.partitionBy("src").orderBy(*_CELL[1:]).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell").over(upto), F.lit(0))).join(aims.drop("source"), "src").drop("cell")
    within = Window.partitionBy(*_CELL).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    served = rows.withColumn("own", F.sum("size").over(within)).join(cells, _CELL)
    end = F.col("before") + F.col("own")
    left = F.floor("target") - (end - F.col("size"))
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), left - (k * F.col("source_size")).cast("long"))) for k in range(most)]
    return served.select(
        *[F.col(f"k_{c}").alias(c) for c in keep], "size", F.col("source_size").cast("long").alias("source_size"), "target",
        sum(parts[1:], parts[0]).cast("long").alias("taken"), F.when(F.col("target") > 0, end / F.col("target")).alias("finish"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """One row per row of ``docs``, range-sorted by virtual finish time: id, ``size`` (words), ``source_size``, ``target``,
    ``taken`` (words the mix takes, repeats counted), ``finish`` (of the first pass).

    The shuffle is a seeded hash of id and text, so reruns agree; rows equal in both are interchangeable.  Null texts have
    size 0 and take nothing.  A null source is a source of its own.  Rows of one id are documents of their own.  Further columns do not matter.  An
    empty table gives no rows."""
    return serve(docs, [id_col], id_col=id_col, **options).orderBy("finish", id_col)


def mixed(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", **options: object) -> DataFrame:
    """The documents of the mix, in its order, with the columns of ``docs``: what the mix takes of a document is its text.
    A second pass follows the first after a newline; a cut pass has its first words, joined by single spaces.
    Documents of which nothing is taken go, so those without words too.  ``count_col``, if present, gets the new length.  Columns of ``docs``
    may have any names."""
    cols, source, key = docs.columns, options.pop("source_col", "source"), options.pop("id_col", "doc_id")
    frame = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in cols if c != text_col], F.lit(0).alias("_")).alias("row"), F.col(text_col).alias("text"), F.col(source).alias("source"), F.col(key).alias("id")
    )
    out = serve(frame, ["row", "text"], id_col="id", store=False, **options).where("taken > 0")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = lambda n: F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")
    text, size, taken = F.col("text"), F.col("size"), F.col("taken")
    more = (
        F.when(taken < size, part(taken)).when(taken == size, text).when(taken == 2 * size, F.concat(text, F.lit("\n"), text)).otherwise(F.concat(text, F.lit("\n"), part(taken - size)))
    )
    out = out.withColumn("text", more).orderBy("finish")
    length = lambda c: F.length("text").cast(docs.schema[c].dataType)
    return out.select(*[(F.col("text") if c == text_col else length(c) if c == count_col else F.col(f"row.`{c}`")).alias(c) for c in cols])
