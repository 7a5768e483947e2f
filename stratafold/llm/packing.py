"""Packing by non-negative least squares over length combinations.

A document is its token ids and a final end id.  Whole windows are cut off its front; the rest, shorter than a window, gives
a piece of a whole number of ``GRID`` tokens and a tail shorter than that.  Combinations of at most ``DEPTH`` grid lengths that
fill a window exactly are enumerated, non-negative least squares against the histogram of grid lengths gives how often each is
repeated, the counts are rounded down to what the histogram holds, and pieces are assigned by their rank within their length.
What no combination takes, and the tails, are packed greedily in order as one stream that is cut at window bounds.
The stream's last, partial window is cut into sequences whose lengths are powers of two, which need no padding.

Rows are taken in an order made from the hash of id and text, and equal rows by their number among them, so the pieces are the same
however the table is partitioned.

Scale: the driver sees the histogram of grid lengths and the number of rows only.  Ranks and stream positions are running
sums in two levels (cells, then rows of a cell), so a length that a third of all documents share is still dealt out.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, saved

WINDOW, GRID, DEPTH, END_ID, CELL_ROWS = 2048, 64, 4, 1, 10_000
VOCABULARY = "byte_bpe_50k"


@functools.cache
def _encoders(vocabulary: str):
    """The public tokenizer, and the same ranks in the faster library; their ids agree on ordinary text."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    lines = open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")), plain


def token_ids(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """Ids of ``tokenizers`` with add_special_tokens=False.  Texts that spell a special token go to that library itself."""
    full, plain = _encoders(vocabulary)
    if "<|endoftext|>" in text:
        return full.encode(text, add_special_tokens=False).ids
    return plain.encode_ordinary(text)


def combinations(window: int = WINDOW, grid: int = GRID, depth: int = DEPTH) -> np.ndarray:
    """All multisets of at most ``depth`` grid lengths that fill the window: how often each length occurs (rows)."""
    units = window // grid
    out: list[list[int]] = []

    def grow(rest: int, largest: int, parts: list[int]) -> None:
        if rest == 0:
            out.append(parts)
        elif len(parts) < depth:
            for k in range(min(rest, largest), 0, -1):
                grow(rest - k, k, [*parts, k])

    grow(units, units - 1, [])
    a = np.zeros((len(out), units))
    for i, parts in enumerate(out):
        for k in parts:
            a[i, k] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson 1974)."""
    m, n = a.shape
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        k = int(gain.argmax())
        if gain[k] <= 1e-9 * scale:
            break
        active[k] = True
        while True:
            cols = np.flatnonzero(active)
            z = np.zeros(n)
            z[cols] = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (z[cols] > 1e-12).all():
                break
            bad = cols[z[cols] <= 1e-12]
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            x[np.abs(x) < 1e-12] = 0
            active &= x > 0
            if not active.any():
                z = np.zeros(n)
                break
        x = z
    return x


def plan(histogram: np.ndarray, window: int = WINDOW, grid: int = GRID, depth: int = DEPTH) -> list[tuple[int, int, int, int, int]]:
    """Slots: (grid length, first rank, count, first sequence, offset) for ``histogram[length]`` pieces of each length.

    The r-th piece of a slot goes to sequence first + r at the offset.  Solved counts are rounded down and then lowered where
    the histogram holds fewer."""
    combos = combinations(window, grid, depth)
    counts = nnls(combos.T, histogram.astype(float))
    order = np.argsort(-counts, kind="stable")
    left, used = histogram.astype(np.int64).copy(), np.zeros_like(histogram, dtype=np.int64)
    slots, sequence = [], 0
    # A second sweep over all combinations takes what rounding left where it fits exactly.
    for times in (np.floor(counts + 1e-9).astype(np.int64), np.full(len(counts), np.iinfo(np.int64).max)):
        for i in order:
            need = combos[i].astype(np.int64)
            has = need > 0
            n = int(min(times[i], (left[has] // need[has]).min()))
            if n <= 0:
                continue
            offset = 0
            for k in np.flatnonzero(has)[::-1]:
                for _ in range(need[k]):
                    slots.append((int(k), int(used[k]), n, sequence, offset))
                    used[k] += n
                    left[k] -= n
                    offset += int(k) * grid
            sequence += n
    return slots


def _tokenised(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids, lengths = [], []
    for text in batch["text"].to_pylist():
        x = np.array([*token_ids(text or ""), END_ID], np.uint32)
        if x.max() > np.iinfo(np.uint16).max:
            raise ValueError(f"token id {x.max()}: ids travel as 16 bits, so a vocabulary has 65,536 entries at most")
        lengths.append(len(x))
        ids.append(x.astype(np.uint16).tobytes())
    yield pa.RecordBatch.from_arrays([batch["id"], batch["h"], pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], ["id", "h", "n", "ids"])


def running(rows: DataFrame, group: str, order: list[str], value: str, salt_rows: int, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before each row of its group, in an order fixed by ``order`` (longs that tell
    the rows of a group apart).  Two levels: cells of the group by the hash of ``order``, then the rows of a cell."""
    cells_n = max(1, salt_rows // CELL_ROWS)
    cell = F.pmod(F.xxhash64(*order), F.lit(cells_n))
    marked = rows.withColumn("cell", cell)
    sums = marked.groupBy(group, "cell").agg(F.sum(value).alias("all"))
    upto = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("all").over(upto), F.lit(0))).drop("all")
    within = Window.partitionBy(group, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return marked.join(sums, [group, "cell"]).withColumn(out, F.col("base") + F.col("own")).drop("cell", "own", "base")


def numbered(tokens: DataFrame, rows: int) -> DataFrame:
    """``row``, ``h``, ``n`` of ``tokens`` and ``copy``, the row's number among those of its hash ``h``: 0 where there is no other.

    Only repeated rows are sorted.  Which of them gets which number is left open, as they are equal."""
    narrow = tokens.select("row", "h", "n")
    often = saved(narrow.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "pack-repeated")
    several = running(narrow.join(often, "h", "left_semi").withColumn("one", F.lit(1)), "h", ["row"], "one", rows, "copy").drop("one")
    return narrow.join(often, "h", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(several)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids`` (unsigned
    16-bit little-endian).

    A null or empty text is its end id only.  Repeated rows, and rows of a null id, are packed each.  Sequences hold ``window`` tokens, except
    the last of the stream, cut into powers of two.  Other columns of ``docs``, whatever their names, are left out.  An empty table gives no rows.
    The same rows give the same pieces under any partitioning; only two different rows whose 64-bit hashes are equal may change places."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    source = source.withColumn("h", F.xxhash64(F.lit(8), "id", F.coalesce("text", F.lit(""))))
    kind = source.schema["id"].dataType.simpleString()
    tokens = map_arrow(source, _tokenised, f"id {kind}, h long, n long, ids binary").withColumn("row", F.monotonically_increasing_id())
    tokens = saved(tokens, "pack-tokens")
    rows, order = tokens.count(), ["h", "copy"]
    lengths = numbered(tokens, rows)
    lengths = saved(lengths.select("row", *order, "n", F.floor(F.col("n") / window).alias("full"), F.floor((F.col("n") % window) / GRID).cast("int").alias("k"), (F.col("n") % window % GRID).alias("tail")), "pack-lengths")
    histogram = np.zeros(window // GRID, np.int64)
    for r in lengths.groupBy("k").agg(F.count("*").alias("c")).collect():  # window / GRID rows at most
        histogram[r["k"]] = r["c"]
    histogram[0] = 0
    slots = plan(histogram, window)
    combined = max([s[3] + s[2] for s in slots], default=0)
    # Whole windows first, then combinations, then the stream.
    whole = running(lengths.withColumn("g", F.lit(0)), "g", order, "full", rows, "full_base").drop("g")
    ranked = running(whole.withColumn("one", F.lit(1)), "k", order, "one", rows, "rank").drop("one")
    table = spark.createDataFrame(slots or [(-1, 0, 0, 0, 0)], "k int, from_rank long, count long, first long, at long")
    slot = F.broadcast(table)  # at most a few rows for each of the enumerated combinations, whatever the input
    fixed = ranked.join(slot.withColumnRenamed("k", "slot_k"), (F.col("k") == F.col("slot_k")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("count")), "left")
    fixed = fixed.withColumn("sequence", F.col("first") + F.col("rank") - F.col("from_rank"))
    # What the combinations left of the grid piece, and the tail, go to the stream.
    fixed = fixed.withColumn("loose", F.when(F.col("sequence").isNull(), F.col("k") * GRID).otherwise(0) + F.col("tail"))
    fixed = saved(fixed.select("row", *order, "n", "full", "k", "tail", "full_base", "sequence", "at", "loose"), "pack-fixed")
    sums = fixed.agg(F.sum("full").alias("full"), F.sum("loose").alias("loose")).first()
    windows, loose = int(sums["full"] or 0), int(sums["loose"] or 0)
    streamed = running(fixed.withColumn("g", F.lit(0)), "g", order, "loose", rows, "stream_at").drop("g", *order)
    rest = loose % window
    ends, at = [], loose - rest
    for bit in reversed(range(window.bit_length())):
        if rest >> bit & 1:
            ends.append((at, at + (1 << bit)))
            at += 1 << bit

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        docs_ids, columns = batch["id"].to_pylist(), {c: batch[c].to_pylist() for c in ("n", "ids", "full", "k", "tail", "full_base", "sequence", "at", "loose", "stream_at")}

        def piece(i: int, start: int, length: int, sequence: int, offset: int) -> None:
            raw = columns["ids"][i][2 * start : 2 * (start + length)]
            wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
            out.append((docs_ids[i], start, length, zlib.crc32(wide), columns["n"][i], sequence, offset, raw))

        for i in range(batch.num_rows):
            full, k = columns["full"][i], columns["k"][i]
            for w in range(full):
                piece(i, w * window, window, columns["full_base"][i] + w, 0)
            start = full * window
            if columns["sequence"][i] is not None:
                piece(i, start, k * GRID, windows + columns["sequence"][i], columns["at"][i])
                start += k * GRID
            place, left = columns["stream_at"][i], columns["loose"][i]
            while left:
                number = windows + combined + place // window
                begin, stop = place // window * window, (place // window + 1) * window
                if place >= loose - rest:
                    number, (begin, stop) = next((windows + combined + (loose - rest) // window + j, e) for j, e in enumerate(ends) if e[0] <= place < e[1])
                length = min(left, stop - place)
                piece(i, start, length, number, place - begin)
                start, place, left = start + length, place + length, left - length
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [pa.int64() if kind == "bigint" else None, *[pa.int64()] * 6, pa.binary()]
    joined = tokens.select("id", "row", "ids").join(streamed, "row")
    return map_arrow(joined.drop("row"), cut, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
