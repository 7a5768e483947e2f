"""Language identification with language-bitmask n-gram filters.

Each learned language owns one bit plane of a bit-sliced Bloom filter: a slot of the filter is a word with a bit for every
language, and an n-gram is looked up at ``HASHES`` slots at once, whose AND is the mask of all languages that contain
it.  A text counts, for each language, the n-grams whose mask has its bit; counts are corrected for the filter's false
positives and for how often the language's own text hits its plane, and the largest decides.

Training counts n-grams inside the tasks over a bounded sample of labelled rows (``SAMPLE``); each plane gets the
``GRAMS`` n-grams most typical of its language, so the model's size grows with the languages only.  A slot has one word for every 64
languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import annotated, bounded_sample, discard, map_arrow, saved

#: Labelled rows a model is fitted on, n-grams kept for each language, lengths in bytes, filter slots and hashes.
SAMPLE, GRAMS, LENGTHS, SLOTS, HASHES = 20_000, 6_000, (2, 4), 1 << 18, 3
#: Bytes of text handled at once; a longer text is handled in parts, so a worker's memory does not depend on it.
SLICE = 1 << 18

_LETTER = r"\p{L}"
_U = np.uint64


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams inside the rows of a text buffer and their start positions.

    ASCII letters are lower-cased; runs of other ASCII bytes count as one kind of separator.  Bytes of longer UTF-8
    sequences are letters here."""
    low = _FOLD[data].astype(np.uint64)
    border = np.zeros(len(low) + 1, bool)
    border[offsets] = True
    out, at = [], []
    for n in LENGTHS:
        if len(low) < n:
            continue
        h = np.zeros(len(low) - n + 1, np.uint64)
        solid = np.zeros(len(h), bool)
        for i in range(n):
            part = low[i : len(low) - n + 1 + i]
            h = h * _U(257) + part
            solid |= part != 32
        for i in range(1, n):  # none reaches over the end of its row
            solid &= ~border[i : len(h) + i]
        pos = np.flatnonzero(solid)
        out.append(K.mix(h[pos] + _U(n << 56)))
        at.append(pos)
    return (np.concatenate(out), np.concatenate(at)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The n-grams of ``texts`` in runs of about ``SLICE`` bytes: first row, number of rows, hashes, and the row of each from the first.
    Parts of one text overlap by what an n-gram that starts at the border needs."""
    for first, data, offsets in K.slices(texts, SLICE):
        for start in range(0, len(data) or 1, SLICE):
            part = data[start : start + SLICE + max(LENGTHS) - 1]
            g, at = grams(part, np.clip(offsets - start, 0, len(part)))
            if len(part) > SLICE:
                g, at = g[at < SLICE], at[at < SLICE]
            yield first, len(offsets) - 1, g, np.searchsorted(offsets, at + start, "right") - 1


def _fold() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[65:91] = np.arange(97, 123)
    t[97:123] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


_FOLD = _fold()


def _slot(grams: np.ndarray, k: int) -> np.ndarray:
    return ((grams >> _U(20 * k)) % _U(SLOTS)).astype(np.int64)


@dataclass(frozen=True)
class LanguageFilter:
    """``slots`` (slot, word: a bit for each language), and for each language its fill and its own hit rate."""

    langs: list[str]
    slots: np.ndarray
    fill: np.ndarray
    own: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Languages that contain each n-gram, as bit masks (n-gram, word)."""
        out = np.full((len(grams), self.slots.shape[1]), ~_U(0))
        for k in range(HASHES):
            out &= self.slots[_slot(grams, k)]
        return out

    def rates(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Share of each text's n-grams in every language's plane, corrected for false positives, and their number."""
        hits, total = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64)
        for first, n, g, row in runs(texts):
            masks = self.masks(g)
            total[first : first + n] += np.bincount(row, minlength=n)
            for i in range(len(self.langs)):
                hits[first : first + n, i] += np.bincount(row[(masks[:, i >> 6] >> _U(i & 63)) & _U(1) != 0], minlength=n)
        rates = hits / np.maximum(total, 1)[:, None]
        return np.clip((rates - self.fill) / np.maximum(1 - self.fill, 1e-9), 0, 1), total

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its share of all languages' corrected, self-scaled rates (0 to 1)."""
        rates, _ = self.rates(texts)
        scaled = (rates / np.maximum(self.own, 1e-9)) ** 4 + 1e-12
        best = scaled.argmax(axis=1)
        return best, scaled[np.arange(len(best)), best] / scaled.sum(axis=1)


def fit(labelled: DataFrame, text: str, lang: str, salt: Column, sample: int = SAMPLE) -> LanguageFilter | None:
    """Fit on at most ``sample`` rows of smallest ``salt`` (see :func:`bounded_sample`); None without rows.  Rows whose text or language is
    null teach nothing."""
    rows = bounded_sample(labelled.where(F.col(lang).isNotNull()), salt, sample).where(F.col(text).isNotNull())
    rows = saved(rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")), "langid-sample")

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = np.array(batch["lang"].to_pylist(), object)
        for name in sorted(set(names)):
            own = batch["text"].filter(pa.array(names == name))
            h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for _, _, g, _ in runs(own):
                more, n = np.unique(g, return_counts=True)
                h, back = np.unique(np.concatenate([h, more]), return_inverse=True)
                c = np.bincount(back, np.concatenate([c, n])).astype(np.int64)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h)), pa.array(h.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    counts = saved(map_arrow(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sums:
        return None
    langs = sorted(sums)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(float(sums[k])))])
    # Typical n-grams: frequent in the language and at least as frequent there as on average elsewhere.
    f = counts.withColumn("f", F.col("n") / share[F.col("lang")])
    every = f.groupBy("gram").agg(F.sum("f").alias("all"))
    typical = f.join(every, "gram").withColumn("weight", F.col("f") * F.log(1 + F.col("f") * len(langs) / F.col("all")))
    typical = typical.where((F.col("f") * len(langs) > F.col("all")) | F.lit(len(langs) == 1))
    ranked = typical.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("weight"), "gram"))).where(F.col("k") <= GRAMS)
    top = ranked.select("lang", "gram").toArrow().to_pandas()
    slots = np.zeros((SLOTS, -(-len(langs) // 64)), np.uint64)
    for i, name in enumerate(langs):
        g = top.loc[top["lang"] == name, "gram"].to_numpy(np.int64).view(np.uint64)
        for k in range(HASHES):
            np.bitwise_or.at(slots[:, i >> 6], _slot(g, k), _U(1 << (i & 63)))
    fill = np.array([((slots[:, i >> 6] >> _U(i & 63)) & _U(1)).mean() ** HASHES for i in range(len(langs))])
    model = LanguageFilter(langs, slots, fill, np.ones(len(langs)))
    # Mean own-plane rate over the sample, from sums made in the tasks.
    index = {k: i for i, k in enumerate(langs)}
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def own(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rates, n = sent.value.rates(batch["text"])
        which = np.array([index[x] for x in batch["lang"].to_pylist()])
        ok = np.flatnonzero(n > 0)
        yield pa.RecordBatch.from_arrays([pa.array(which[ok]), pa.array(rates[ok, which[ok]])], ["lang", "rate"])

    means = {r["lang"]: r["rate"] for r in map_arrow(rows, own, "lang long, rate double").groupBy("lang").agg(F.avg("rate").alias("rate")).collect()}
    discard(rows, counts)
    return LanguageFilter(langs, slots, fill, np.array([means.get(i, 1.0) or 1.0 for i in range(len(langs))]))


def identify(docs: DataFrame, model: LanguageFilter | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (a learned language; ``und`` where the text is null or has no letter, or nothing was learned) and
    ``score`` (0 to 1; 0 for ``und``).

    Every row is kept, repeated ones too, and each is judged by its text alone.  Columns of ``docs`` that are named like the two are replaced.
    An empty table gives no rows."""
    bare = F.coalesce(~F.rlike(F.col(text), F.lit(_LETTER)), F.lit(True))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array, bare: pa.Array) -> list[pa.Array]:
        m, und = sent.value, bare.to_numpy(zero_copy_only=False).copy()
        if m is None:
            und[:] = True
            return [pa.array(["und"] * len(und)), pa.array(np.zeros(len(und)))]
        best, score = m.predict(texts)
        names = np.array(m.langs, object)[best]
        names[und] = "und"
        score[und] = 0.0
        return [pa.array(names, pa.string()), pa.array(score)]

    return annotated(docs, text, predict, "lang_pred string, score double", bare)
