"""Spelling variants by k-d trees over letter-count vectors.

One inserted, deleted or replaced letter moves a word's vector of letter counts by one or two in L1 distance: a replacement keeps the length and
moves one count up and one down, an insertion moves one count up.  So the near words of a word are found by two range searches, one among the
words of its length and one among those one letter longer, and each pair found has the order of its letters verified.

The search is dealt out by an upper k-d tree for each length, fitted on a bounded sample of the vocabulary (the sample only shapes the cells).
Every word is indexed in its one cell and sent as a query to all cells whose box it may reach.  A task builds a k-d tree over the index words of
a cell and searches it for all queries of the cell at once.  Cells that hold too many words or queries are cut into blocks, so that every query
still meets every index word of its cell in exactly one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, saved

#: Words need this many letters and occurrences; a form occurs this many times as often as its variant.
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: Words meant for a cell; index words and queries of a block at most (in the mean); words of the sample that shapes the trees, and least of a leaf.
CELL, BLOCK, QUERIES, SAMPLE, LEAST = 4096, 8192, 65_536, 200_000, 8
#: Words routed at once, words in a leaf of a task's tree, entries of a product of vectors.
ROUTE, LEAF, PRODUCT = 16_384, 64, 4_000_000

_ROWS = "leaf long, query boolean, word string, n long"


def codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length, a row for each word."""
    return np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).reshape(len(words), -1)


def vectors(letters: np.ndarray) -> np.ndarray:
    """Counts of a-z and of the 64 letters from U+00C0."""
    n, length = letters.shape
    dim = np.where(letters < 128, letters - 97, letters.astype(np.int64) - 0xC0 + 26)
    flat = (np.arange(n)[:, None] * 90 + dim).ravel()
    return np.bincount(flat, minlength=n * 90).reshape(n, 90).astype(np.int16 if length < 1 << 15 else np.int32)


def build(v: np.ndarray, rows: np.ndarray, most: float) -> tuple:
    """K-d tree of the vectors ``rows``: (letter, highest count on the left, left, right), or (None, rows) for a leaf.

    Each node is cut at the letter and count that halve it best; vectors that are all equal stay together."""
    if len(rows) <= most:
        return None, rows
    own = v[rows]
    middle = np.median(own, axis=0).astype(own.dtype)
    best = (0.0, 0, 0)
    for at in (middle, middle - 1):
        left = (own <= at).mean(axis=0)
        even = np.minimum(left, 1 - left)
        d = int(even.argmax())
        best = max(best, (float(even[d]), d, int(at[d])))
    even, d, at = best
    if not even:
        return None, rows
    low = own[:, d] <= at
    return d, at, build(v, rows[low], most), build(v, rows[~low], most)


def search(tree: tuple, v: np.ndarray, rows: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves whose box the vectors ``rows`` may reach when counts rise by ``up`` and fall by ``down`` in all; with those that reach it."""
    zero = np.zeros(len(rows), v.dtype)
    todo = [(tree, rows, zero, zero, {})]
    while todo:
        node, rows, rise, fall, box = todo.pop()
        if node[0] is None:
            yield node[1], rows
            continue
        d, at, left, right = node
        low, high = box.get(d, (None, None))
        q = v[rows, d]
        # The distance along this letter replaces the one of the wider box above.
        less = fall + np.maximum(q - at, 0) - (0 if high is None else np.maximum(q - high, 0))
        more = rise + np.maximum(at + 1 - q, 0) - (0 if low is None else np.maximum(low - q, 0))
        for child, rise_to, fall_to, sides in ((left, rise, less, (low, at)), (right, more, fall, (at + 1, high))):
            ok = (rise_to <= up) & (fall_to <= down)
            if ok.any():
                todo.append((child, rows[ok], rise_to[ok], fall_to[ok], box | {d: sides}))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters of ``b`` are those of ``a`` with one letter replaced (equal widths) or inserted (one more column)."""
    n, length = a.shape
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    differ, shifted = a != b[:, :-1], a != b[:, 1:]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    last = np.where(shifted.any(axis=1), length - 1 - shifted[:, ::-1].argmax(axis=1), -1)
    return last < first


def near_pairs(index: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, index word) of all pairs one edit apart; the index words have one length, the queries that length or one less."""
    if not index or not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact = np.float32 if len(index[0]) < 2000 else np.float64
    letters = codes(index)
    v = vectors(letters)
    tree, found = build(v, np.arange(len(index)), LEAF), []
    points = v.astype(exact)
    square = (points * points).sum(axis=1)
    for longer in (0, 1):
        mine = np.array([i for i, q in enumerate(queries) if len(q) + longer == len(index[0])], np.int64)
        if not len(mine):
            continue
        theirs = codes([queries[i] for i in mine])
        qv = vectors(theirs).astype(v.dtype)
        q_points = qv.astype(exact)
        q_square = (q_points * q_points).sum(axis=1)
        for leaf, rows in search(tree, qv, np.arange(len(mine)), 1, 1 - longer):
            for lo in range(0, len(rows), max(1, PRODUCT // len(leaf))):
                r = rows[lo : lo + max(1, PRODUCT // len(leaf))]
                # Whole numbers whose squares sum to 2 (or 1) are two counts off by one (or one): the L1 distance asked for.
                apart = q_square[r][:, None] + square[leaf] - 2 * (q_points[r] @ points[leaf].T)
                i, j = np.nonzero(apart == 2 - longer)
                i, j = r[i], leaf[j]
                for at in range(0, len(i), PRODUCT // 16):
                    a, b = i[at : at + PRODUCT // 16], j[at : at + PRODUCT // 16]
                    ok = one_edit(theirs[a], letters[b])
                    found.append((mine[a[ok]], b[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def cells(sample: list[str], sizes: dict[int, int]) -> dict[int, tuple]:
    """Upper tree of each length, its leaves numbered; ``sizes`` has the words of each length."""
    trees, by = {}, {}
    for w in sample:
        by.setdefault(len(w), []).append(w)
    for length, n in sizes.items():
        own = by.get(length, [])
        number = iter(range(1 << 32))

        def numbered(node: tuple, length: int = length, number: Iterator[int] = number) -> tuple:
            return (None, (length << 32) + next(number)) if node[0] is None else (*node[:2], numbered(node[2]), numbered(node[3]))

        # A leaf of the sample stands for about CELL words.
        trees[length] = numbered(build(vectors(codes(own)), np.arange(len(own)), max(LEAST, CELL * len(own) / n)) if own else (None, None))
    return trees


def _routed(trees: dict[int, tuple]):
    """Rows of each word: its own cell as an index word, and as a query the cells that it may reach."""

    def route(words: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for length, rows in by.items():
            place = np.array(rows)
            v = vectors(codes([words[i] for i in rows]))
            every = np.arange(len(rows))
            for tree, up, down, query in ((trees[length], 0, 0, False), (trees[length], 1, 1, True), (trees.get(length + 1), 1, 0, True)):
                if tree is None:
                    continue
                for leaf, own in search(tree, v, every, up, down):
                    at = place[own]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf)), pa.array(np.full(len(at), query)), pa.array([words[i] for i in at]), pa.array(n[at])], ["leaf", "query", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = [], []
        for batch in batches:
            words += batch["word"].to_pylist()
            n.append(batch["n"].to_numpy())
            if len(words) >= ROUTE:
                yield from route(words, np.concatenate(n))
                words, n = [], []
        if words:
            yield from route(words, np.concatenate(n))

    return run


def _matched(table: pa.Table) -> pa.Table:
    """Of one block: each near pair, from both sides where the lengths differ."""
    query = table["query"].to_numpy(zero_copy_only=False)
    word, n = table["word"].to_pylist(), table["n"].to_numpy()
    index, asked = np.flatnonzero(~query), np.flatnonzero(query)
    q, p = near_pairs([word[i] for i in index], [word[i] for i in asked])
    q, p = asked[q], index[p]
    other = np.array([len(word[a]) < len(word[b]) for a, b in zip(q, p, strict=True)], bool)
    a, b = np.concatenate((q, p[other])), np.concatenate((p, q[other]))
    return pa.table({"word": pa.array([word[i] for i in a], pa.string()), "near": pa.array([word[i] for i in b], pa.string()), "n": pa.array(n[b])})


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and their number ``n`` over all texts, with the deletions that the row's id and the run decide; short and rare ones are left out.

    A null id counts as an empty one.  A run that loses a letter needs one letter more, so shorter runs are passed over."""
    run = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[A-Za-z\u00C0-\u00FF]{{{LETTERS},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(run).alias("run"))
    low = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    hashed = low.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    cut = "CASE WHEN h % 199 = 0 THEN concat(left(run, int(h % length(run))), substr(run, int(h % length(run)) + 2)) ELSE run END"
    words = hashed.select(F.expr(cut).alias("word")).where(F.length("word") >= LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OCCURRENCES)


def near_words(words: DataFrame) -> DataFrame:
    """All ordered pairs (word, near, n of near) of the distinct ``words`` (word, n) that are one edit apart."""
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    sample = [r["word"] for r in bounded_sample(words.select("word"), F.xxhash64("word"), SAMPLE).collect()]
    routed = saved(words.mapInArrow(_routed(cells(sample, sizes)), _ROWS), "spelling-cells")
    held = saved(routed.groupBy("leaf").agg(F.count_if(~F.col("query")).alias("own"), F.count_if("query").alias("asked")), "spelling-sizes")
    mark = F.xxhash64("word")
    dealt = routed.join(held.where("own > 0"), "leaf")
    i, j = F.ceil(F.col("own") / BLOCK).cast("int"), F.ceil(F.col("asked") / QUERIES).cast("int")
    mine = F.when(F.col("query"), F.pmod(mark, j.cast("long"))).otherwise(F.pmod(mark, i.cast("long"))).cast("int")
    # An index word goes to every block of queries and a query to every block of index words.
    dealt = dealt.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), i).otherwise(F.greatest(j, F.lit(1))) - 1)))
    block = dealt.select("leaf", F.when(F.col("query"), F.col("theirs")).otherwise(F.col("mine")).alias("i"), F.when(F.col("query"), F.col("mine")).otherwise(F.col("theirs")).alias("j"), "query", "word", "n")
    return block.groupBy("leaf", "i", "j").applyInArrow(_matched, "word string, near string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of the links ``forms`` (word, form), which hold no cycle: the last form reached.  Each round doubles the way gone."""
    at = saved(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not at.where("moved").isEmpty():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = at.select("word", "root").join(ahead, "root", "left")
        last, at = at, saved(further.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(last)
    return at.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word of :func:`vocabulary`: ``word``, its ``form`` (the near word of largest number, ties by the smaller one, if that number
    is ``RATIO`` times the word's) and ``root`` (the last form reached, the word itself if none), ``n``, ``n_near`` and ``form_n``.

    Null and empty texts hold no words; rows of equal ids and texts count each; further columns do not matter; an empty table gives no rows."""
    words = saved(vocabulary(docs, id_col, text_col), "spelling-words")
    best = F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best")
    near = saved(near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best), "spelling-near")
    enough = -F.col("best.less") >= RATIO * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    known = saved(known, "spelling-forms")
    discard(words, near)
    found = known.join(roots(known.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
