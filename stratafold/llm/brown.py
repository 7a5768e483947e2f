"""Brown class bigrams: exchange clustering puts words into classes; class transitions and word emissions score a text.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)).  Every training word that occurs ``LEAST`` times or more is clustered.  The
``SEEDS`` most frequent words start the classes: each iteration a Spark job sums how often they stand beside every class, and the
driver moves them to the class that raises the class bigrams' likelihood most.  All the others then choose, in tasks, the class
that raises it most against the class bigrams of the start; their neighbours have the classes they had at the start, and the words
placed at once do not see each other's moves.  Rarer words belong to one of ``RARE`` fixed classes by the hash of their last
two bytes; the end of a text is a class of its own.  Class bigrams and emissions of the model are counted with the final classes.

Counts of words cover all training documents.  Words are named by 64-bit hashes.  Counts and classes are a table (word, n, c); those of the
most frequent words also travel with the tasks, the other words of a text are joined with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import discard, map_arrow, saved

#: Words that start the classes, classes, fixed classes of rare words, passes of the start, table entries a task holds before it sends them.
SEEDS, CLASSES, RARE, PASSES, HELD = 4096, 48, 16, 4, 600_000
#: Occurrences from which a word is clustered; contexts meant for one group of words, and held by a task before it sends them.
LEAST, GROUP, CONTEXTS = 5, 4_000_000, 3_000_000
#: All classes: clustered, fixed, the end of a text; the mark of a word whose class is joined.
TOTAL, FAR = CLASSES + RARE + 1, 255
#: Words whose counts and classes travel with the tasks when scoring: bounds the broadcast, not the result.
KNOWN = 131_072
#: Weight of the class distribution in a transition.
PRIOR = 5.0

_U = np.uint64
END = int(K.mix(np.array([3], np.uint64)).view(np.int64)[0])


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, token names (signed; each row's words and one end) and row bounds.

    A name is 60 bits of the word's hash below four bits of the hash of its last two bytes, its fixed class."""
    for first, data, offsets in K.slices(texts):
        starts, ends, bounds = K.words(data, offsets)
        rows = len(offsets) - 1
        out = np.full(len(starts) + rows, END, np.int64)
        if len(starts):
            low = K.VALUE[data]
            two = low[ends - 1] + np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)] * _U(3), _U(0))
            name = K.word_hashes(data, starts, ends) >> _U(4) | K.mix(two) >> _U(60) << _U(60)
            out[np.arange(len(starts)) + np.repeat(np.arange(rows), np.diff(bounds))] = name.view(np.int64)
        yield first, out, bounds + np.arange(rows + 1)


def tail(word: np.ndarray) -> np.ndarray:
    """Fixed class of each token name."""
    return (word.view(np.uint64) >> _U(60)).astype(np.int64)


def _summed(size: int):
    """Merges (key, n) arrays of int64 keys; hands over what it holds beyond ``size`` entries."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge(keys: np.ndarray, counts: np.ndarray | None = None, last: bool = False):
        if len(keys):
            if counts is None:
                keys, counts = np.unique(keys, return_counts=True)
            held.append((keys, counts.astype(np.int64)))
        if last or sum(len(k) for k, _ in held) > 2 * size:
            if not held:
                return None
            k, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            c = np.bincount(back, np.concatenate([x for _, x in held])).astype(np.int64)
            held.clear()
            if last or len(k) > size:
                return k, c
            held.append((k, c))
        return None

    return merge


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each token occurs; sums are begun inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _summed(HELD)
        send = lambda got: pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["word", "n"])
        for batch in batches:
            for _, word, _ in tokens(batch[text]):
                if got := merge(word):
                    yield send(got)
        if got := merge(np.zeros(0, np.int64), last=True):
            yield send(got)

    return texts.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(left: np.ndarray, right: np.ndarray, own: np.ndarray, classes: int, labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One pass: half of the words, in order of frequency, go to the class that raises the likelihood most.

    ``left[w, c]`` counts w after a word of class c, ``right[w, c]`` w before one; columns beyond ``classes`` are fixed
    classes.  Class bigrams follow the moves; the neighbours' labels are those of the pass's start."""
    labels = labels.copy()
    total = left.shape[1]
    n = np.zeros((total, total))  # n[a, b]: class a before class b, for moving words only
    np.add.at(n.T, labels, left)
    np.add.at(n, labels, right)
    size = np.bincount(labels, own, minlength=total)
    f = lambda x: x * np.log(np.maximum(x, 1e-9))
    moving = np.flatnonzero(rng.random(len(labels)) < 0.5)
    for w in moving[np.argsort(-own[moving], kind="stable")]:
        a = labels[w]
        n[:, a] -= left[w]
        n[a] -= right[w]
        size[a] -= own[w]
        # Rows and columns that would change: the gain of each class as the new home.
        gain = (f(n[:, :classes] + left[w][:, None]) - f(n[:, :classes])).sum(axis=0)
        gain += (f(n[:classes] + right[w][None]) - f(n[:classes])).sum(axis=1)
        gain -= 2 * (f(size[:classes] + own[w]) - f(size[:classes]))
        b = int(gain.argmax())
        labels[w] = b
        n[:, b] += left[w]
        n[b] += right[w]
        size[b] += own[w]
    return labels


def _gain(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    f = lambda v: v * np.log(np.maximum(v, 1e-9))
    return f(x + more) - f(x)


def _contexts(texts: DataFrame, text: str, seeds: np.ndarray, labels: np.ndarray, groups: int) -> DataFrame:
    """Rows (part, words, entries, beside, n) of a run of words, packed: how often each word but the seeds stands after a class (0 ..) or
    before one (``TOTAL`` ..).  A word has at most 2 * ``TOTAL`` entries in a row, however often it occurs."""
    sent = texts.sparkSession.sparkContext.broadcast((seeds, labels))
    schema = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("words", "entries", "beside", "n"))])

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        word, back = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        part = (word.view(np.uint64) % _U(groups)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        key, n = np.unique(place[back] * (2 * TOTAL) + np.concatenate([k for _, k in held]), return_counts=True)
        word, part, who = word[order], part[order], key // (2 * TOTAL)
        entries, beside, n = np.bincount(who).astype(np.uint8), (key % (2 * TOTAL)).astype(np.uint8), n.astype(np.uint32)
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        to = np.append(at[1:], len(part))
        lo, hi = np.searchsorted(who, at), np.searchsorted(who, to)
        blobs = [[x[i:j].tobytes() for i, j in zip(a, b, strict=True)] for x, a, b in ((word, at, to), (entries, at, to), (beside, lo, hi), (n, lo, hi))]
        return pa.RecordBatch.from_arrays([pa.array(part[at]), *(pa.array(x, pa.binary()) for x in blobs)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, labels = sent.value
        held, size = [], 0
        for batch in batches:
            for _, word, _ in tokens(batch[text]):
                cls = np.where(word == END, CLASSES + RARE, CLASSES + tail(word))
                free = word != END
                if len(seeds):
                    at = np.minimum(np.searchsorted(seeds, word), len(seeds) - 1)
                    known = seeds[at] == word
                    cls[known] = labels[at[known]]
                    free &= ~known
                pick = np.flatnonzero(free)  # never the last token, which is an end
                before = np.where(pick > 0, cls[pick - 1], CLASSES + RARE)
                if len(pick):
                    held += [(word[pick], before), (word[pick], TOTAL + cls[pick + 1])]
                size += 2 * len(pick)
                if size >= CONTEXTS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return texts.select(text).mapInArrow(run, "part long, words binary, entries binary, beside binary, n binary")


def _placed(contexts: DataFrame, moves: np.ndarray) -> DataFrame:
    """(word, c): of the words of ``LEAST`` occurrences or more the class that raises the likelihood of the class bigrams most."""
    sent = contexts.sparkSession.sparkContext.broadcast((np.concatenate((moves[:, :CLASSES], moves.T[:, :CLASSES])), moves.sum(axis=0)[:CLASSES]))

    def place(table: pa.Table) -> pa.Table:
        beside_class, size = sent.value
        word, entries, beside, n = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("words", np.int64), ("entries", np.uint8), ("beside", np.uint8), ("n", np.uint32)))
        word, back = np.unique(word, return_inverse=True)
        key, at = np.unique(np.repeat(back, entries) * (2 * TOTAL) + beside, return_inverse=True)
        n = np.bincount(at, n)
        who, beside = key // (2 * TOTAL), key % (2 * TOTAL)
        own = np.bincount(who, n, minlength=len(word)) / 2  # every occurrence has a class before and one after
        keep = own >= LEAST
        stay = keep[who]
        who, beside, n = (np.cumsum(keep) - 1)[who[stay]], beside[stay], n[stay]
        word, own = word[keep], own[keep]
        start = np.searchsorted(who, np.arange(len(word) + 1))
        out = np.zeros(len(word), np.int32)
        i = 0
        while i < len(word):
            j = max(i + 1, int(np.searchsorted(start, start[i] + 50_000, "right")) - 1)
            part = slice(start[i], start[j])
            gain = np.add.reduceat(_gain(beside_class[beside[part]], n[part, None]), start[i:j] - start[i])
            out[i:j] = (gain - 2 * _gain(size, own[i:j, None])).argmax(axis=1)
            i = j
        return pa.table({"word": pa.array(word), "c": pa.array(out)})

    return contexts.groupBy("part").applyInArrow(place, "word long, c int")


@dataclass(frozen=True)
class BrownModel:
    """Words that travel with the tasks (sorted hashes) with counts and classes, log10 transitions, log10 class totals, corpus totals."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    clustered: int
    moves: np.ndarray
    emit: np.ndarray
    tokens: int
    vocabulary: int


def _coded(source: DataFrame, table: DataFrame, words: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> DataFrame:
    """``source`` (id, row, text) as (id, row, n_tokens, hits, logs, seq, tails, at, found): the class of each token in a byte; the fixed
    classes of the words that do not travel (``FAR``), with their places and what the table (word, n, c) holds of them.  Their names, the
    most of a row, are only in what is joined with the table."""
    sent = source.sparkSession.sparkContext.broadcast((words, np.log10(np.append(counts, 0) + 1.0), classes))

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, log_counts, own = sent.value
        rows = batch.num_rows
        n, hits, logs = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
        seq, places, tails = [b""] * rows, [b""] * rows, [b""] * rows
        far: list = [[]] * rows
        for first, word, bounds in tokens(batch["text"]):
            at = np.full(len(word), -1)
            if len(names):
                at = np.minimum(np.searchsorted(names, word), len(names) - 1)
                at = np.where(names[at] == word, at, -1)
            hit = at >= 0
            cls = np.full(len(word), FAR, np.uint8)
            cls[hit] = own[at[hit]]
            lg = np.concatenate(([0.0], np.cumsum(log_counts[at])))  # the last count, 0, stands for no word that travels
            for i in range(len(bounds) - 1):
                a, b = bounds[i], bounds[i + 1]
                r = first + i
                n[r], hits[r], logs[r], seq[r] = b - a, hit[a:b].sum(), lg[b] - lg[a], cls[a:b].tobytes()
                if hits[r] < n[r]:
                    far[r], back = np.unique(word[a:b][~hit[a:b]], return_inverse=True)
                    places[r], tails[r] = back.astype(np.uint32).tobytes(), tail(far[r]).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["row"], pa.array(n), pa.array(hits), pa.array(logs), pa.array(seq, pa.binary()), pa.array(far, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(places, pa.binary())],
            ["id", "row", "n_tokens", "hits", "logs", "seq", "words", "tails", "at"],
        )

    kind = source.schema["id"].dataType.simpleString()
    coded = saved(map_arrow(source, parts, f"id {kind}, row long, n_tokens long, hits long, logs double, seq binary, words array<long>, tails binary, at binary"), "brown-parts")
    far = coded.select("row", F.posexplode("words").alias("i", "word"))
    found = far.join(table, "word").groupBy("row").agg(F.collect_list(F.struct("i", "n", "c")).alias("found"))
    out = coded.drop("words").join(found, "row", "left")
    out._parts = coded
    return out


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a batch of coded texts: all classes in order, each row's bounds, tokens found in the table and the sum of their log10 counts."""
    rows = batch.num_rows
    sizes = batch["n_tokens"].to_numpy()
    seq = np.frombuffer(b"".join(batch["seq"].to_pylist()), np.uint8).astype(np.int64)
    lengths = lambda c: pc.fill_null(pc.list_value_length(batch[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    tails = batch["tails"].to_pylist()
    held = np.array([len(x) for x in tails], np.int64)
    start = np.cumsum(held) - held
    cls = CLASSES + np.frombuffer(b"".join(tails), np.uint8).astype(np.int64)
    n = np.zeros(len(cls), np.int64)
    items = batch["found"].flatten()
    to = np.repeat(start, lengths("found")) + items.field("i").to_numpy()
    cls[to], n[to] = items.field("c").to_numpy(), items.field("n").to_numpy()
    raw = batch["at"].to_pylist()
    spots = np.array([len(x) // 4 for x in raw], np.int64)
    at = np.frombuffer(b"".join(raw), np.uint32) + np.repeat(start, spots)
    seq[seq == FAR] = cls[at]
    owner = np.repeat(np.arange(rows), spots)
    return seq, np.concatenate(([0], np.cumsum(sizes))), np.bincount(owner, n[at] > 0, minlength=rows).astype(np.int64), np.bincount(owner, np.log10(n[at] + 1.0), minlength=rows)


def _transitions(coded: DataFrame) -> np.ndarray:
    """Class bigrams of coded texts; every text begins after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOTAL * TOTAL, np.int64)
        for batch in batches:
            if batch.num_rows:
                seq = _read(batch)[0]
                total += np.bincount(np.concatenate(([CLASSES + RARE], seq[:-1])) * TOTAL + seq, minlength=TOTAL * TOTAL)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    sums = coded.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TOTAL * TOTAL)
    out[sums["k"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(TOTAL, TOTAL)


def _frequent(counts: DataFrame) -> pd.DataFrame:
    """The words of the highest counts, as many whole steps of the counts' logarithm as stay within KNOWN words.

    The steps' sizes come to the driver first, so no task sorts or sends more than is kept."""
    step = F.floor(8 * F.log2("n"))
    sizes = {r["s"]: r["v"] for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("v")).collect()}
    low, held = None, 0
    for s in sorted(sizes, reverse=True):
        held += sizes[s]
        if held > KNOWN:
            break
        low = s
    return counts.where(step >= low if low is not None else F.lit(False)).toArrow().to_pandas()


def _classes(texts: DataFrame, text: str, seed: int) -> tuple[DataFrame, tuple[np.ndarray, ...], tuple[int, int]]:
    """The table of all training words (word, n, c): counts and classes; names, counts and classes of those that travel; tokens and vocabulary."""
    spark = texts.sparkSession
    counts = saved(word_counts(texts, text), "brown-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = _frequent(counts)
    inner = top[top["word"] != END].sort_values(["n", "word"], ascending=[False, True]).head(SEEDS)
    words = np.sort(inner["word"].to_numpy(np.int64))
    own = inner.set_index("word")["n"].reindex(words).to_numpy(float)
    classes = CLASSES + RARE + 1
    # Start: by frequency rank, so that frequent words are spread.
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-own, kind="stable")] = np.arange(len(words))
    labels = rank % CLASSES
    sent = spark.sparkContext.broadcast(words)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bigrams as pairs of symbols: the number of a clustered word, or SEEDS + its fixed class."""
        merge, base = _summed(HELD), SEEDS + RARE + 1
        known = sent.value

        def send(got: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(got[0] // base), pa.array(got[0] % base), pa.array(got[1])], ["a", "b", "n"])

        for batch in batches:
            for _, word, _ in tokens(batch[text]):
                symbol = np.where(word == END, SEEDS + RARE, SEEDS + tail(word))
                if len(known):
                    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                    symbol = np.where(known[at] == word, at, symbol)
                before = np.concatenate(([SEEDS + RARE], symbol[:-1]))
                if got := merge(before * base + symbol):
                    yield send(got)
        if got := merge(np.zeros(0, np.int64), last=True):
            yield send(got)

    bigrams = saved(texts.select(text).mapInArrow(pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "brown-bigrams")

    def tables(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of words beside classes, and of class bigrams, over the whole table."""
        full = np.concatenate((labels, np.zeros(SEEDS - len(labels), np.int64), CLASSES + np.arange(RARE + 1)))
        to = spark.createDataFrame([(i, int(c)) for i, c in enumerate(full)], "s long, c long")
        ca = to.select(F.col("s").alias("a"), F.col("c").alias("ca"))
        cb = to.select(F.col("s").alias("b"), F.col("c").alias("cb"))
        both = bigrams.join(F.broadcast(ca), "a").join(F.broadcast(cb), "b")
        sums = both.select(
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("kind"), F.col("b").alias("w"), F.col("ca").alias("c"), "n"),
                    F.struct(F.lit(1).alias("kind"), F.col("a").alias("w"), F.col("cb").alias("c"), "n"),
                    F.struct(F.lit(2).alias("kind"), F.col("ca").alias("w"), F.col("cb").alias("c"), "n"),
                )
            ).alias("x")
        ).select("x.*").where(f"kind = 2 or w < {len(labels)}").groupBy("kind", "w", "c").agg(F.sum("n").alias("n")).toArrow().to_pandas()
        out = [np.zeros((len(labels), classes)), np.zeros((len(labels), classes)), np.zeros((classes, classes))]
        for kind, own in sums.groupby("kind"):
            out[kind][own["w"].to_numpy(), own["c"].to_numpy()] = own["n"].to_numpy()
        return out[0], out[1], out[2]

    rng = np.random.default_rng(seed)
    best, best_value = labels, -np.inf
    for step in range(PASSES + 1):
        left, right, moves = tables(labels)
        size = moves.sum(axis=0)
        value = float((moves * np.log(np.maximum(moves, 1))).sum() - 2 * (size * np.log(np.maximum(size, 1))).sum())
        if value > best_value:
            best, best_value, best_moves = labels, value, moves
        if step < PASSES and len(words):
            labels = exchange(left, right, own, CLASSES, labels, rng)
    groups = int(max(12, 1 + 2 * (total["n"] or 0) // GROUP))
    placed = _placed(_contexts(texts, text, words, best, groups), best_moves)
    fixed = spark.createDataFrame([*zip(words.tolist(), best.tolist(), strict=True), (END, CLASSES + RARE)], "word long, c int")
    labelled = counts.join(placed.unionAll(fixed), "word", "left")
    table = saved(labelled.select("word", "n", F.coalesce("c", (F.shiftrightunsigned("word", 60) + CLASSES).cast("int")).alias("c")), "brown-classes")
    discard(counts, bigrams)
    known = _frequent(table).sort_values("word")
    sent_words = known["word"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["c"].to_numpy(np.int64)
    return table, sent_words, (int(total["n"] or 0), int(total["v"] or 0))


def _model(table: DataFrame, sent_words: tuple[np.ndarray, ...], totals: tuple[int, int], final: np.ndarray) -> BrownModel:
    """The model from class bigrams that are counted with the final classes."""
    classes, size = CLASSES + RARE + 1, final.sum(axis=0)
    share = (size + 1) / (size + 1).sum()
    moves = np.log10((final + PRIOR * classes * share[None]) / (final.sum(axis=1, keepdims=True) + PRIOR * classes))
    # Distinct words of each class, for its emissions.
    distinct = np.zeros(classes)
    for r in table.groupBy("c").agg(F.count("*").alias("v")).collect():  # TOTAL rows
        distinct[r["c"]] = r["v"]
    emit = np.log10(size + distinct + 1)
    return BrownModel(*sent_words, int(distinct[:CLASSES].sum()), moves, emit, *totals)


def _source(docs: DataFrame, text: str, name: Column) -> DataFrame:
    return docs.select(name.alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))


def fit(texts: DataFrame, text: str, seed: int = 11) -> tuple[BrownModel, DataFrame]:
    """The model of the training texts and the table of all their words (word, n, c): counts and classes."""
    table, sent_words, totals = _classes(texts, text, seed)
    coded = _coded(_source(texts, text, F.lit(None).cast("long")), table, *sent_words)
    final = _transitions(coded)
    discard(coded._parts)
    return _model(table, sent_words, totals, final), table


def _scored(coded: DataFrame, model: BrownModel, id_col: str) -> DataFrame:
    sent = coded.sparkSession.sparkContext.broadcast((model.moves, model.emit))

    def finish(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        moves, emit = sent.value
        seq, bounds, more, more_logs = _read(batch)
        before = np.concatenate(([CLASSES + RARE], seq[:-1]))
        own = np.concatenate(([0.0], np.cumsum(moves[before, seq] - emit[seq])))
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["n_tokens"], pa.array(batch["hits"].to_numpy() + more), pa.array(batch["logs"].to_numpy() + more_logs), pa.array(own[bounds[1:]] - own[bounds[:-1]])],
            ["id", "n_tokens", "n_known", "logs", "rest"],
        )

    kind = coded.schema["id"].dataType.simpleString()
    out = map_arrow(coded, finish, f"id {kind}, n_tokens long, n_known long, logs double, rest double")
    base = F.lit(float(np.log10(model.tokens + model.vocabulary + 1)))
    return out.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * base).alias("base_score"), (F.col("logs") + F.col("rest")).alias("score"),
    )


def score(docs: DataFrame, model: BrownModel, counts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document row: id, n_tokens, n_known, train_tokens, base_score, score (both log10 probabilities of the text)."""
    coded = _coded(_source(docs, text_col, F.col(id_col)), counts, model.words, model.counts, model.classes)
    return _scored(coded, model, id_col)


def fit_score(docs: DataFrame, teaches: Column, id_col: str, text_col: str, seed: int = 11) -> DataFrame:
    """:func:`fit` on the rows that ``teaches`` and :func:`score` of all rows: texts are coded and joined with the table of words once, for both."""
    table, sent_words, totals = _classes(docs.where(teaches), text_col, seed)
    made = _coded(_source(docs, text_col, F.struct(F.col(id_col).alias("id"), teaches.alias("teaches"))), table, *sent_words)
    coded = saved(made, "brown-coded")
    discard(made._parts)
    model = _model(table, sent_words, totals, _transitions(coded.where("id.teaches")))
    return _scored(coded.withColumn("id", F.col("id.id")), model, id_col)


def perplexity(log10_score: Column, n_tokens: Column) -> Column:
    """Perplexity per token; null without tokens."""
    return F.pow(F.lit(10.0), -F.try_divide(log10_score, n_tokens))
