"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is its hashed word vector beside the mean of its hashed character trigram vectors.  A text is read in overlapping
windows of ``WINDOW`` words, ``STRIDE`` apart; a forward and a backward GRU run over all windows of a
batch side by side, attention pools their states, and a logistic unit scores the window.  A text's score is calibrated from
its highest window.

Training is multiple-instance learning on a bounded sample of labelled texts: windows of clean texts are negative; of a
toxic text, the window that holds its strongest word (by likelihood ratio of document counts in the sample) is positive at first,
later the window the network itself ranks highest.  Words seen in fewer than two sampled texts share the unknown
vector and are told apart by their characters only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import annotated, bounded_sample, discard, saved

#: Labelled texts and bytes of text in the training sample; bytes of the longest text sampled whole.
SAMPLE, SAMPLE_BYTES, LONGEST = 5000, 10_000_000, 40_000
WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, CHAR_SLOTS, MAX_WORDS = 16, 8, 8, 8, 8, 2048, 20_000
ROUNDS, STEPS, BATCH, RATE = 3, 120, 192, 0.01
#: Strength (root of the likelihood ratio) from which a word marks its window as positive at first.
SURE = 3.5
#: Windows scored side by side.
SIDE = 2048

_U = np.uint64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.asarray(0.5, x.dtype)


@dataclass(frozen=True)
class Text:
    """Words of a run of rows: the distinct words' hashes and trigram slots, each word's number, row bounds."""

    hashes: np.ndarray
    grams: np.ndarray
    gram_bounds: np.ndarray
    word: np.ndarray
    bounds: np.ndarray


def read(data: np.ndarray, offsets: np.ndarray) -> Text:
    """Split a run of rows; characters are looked at once for each distinct word."""
    starts, ends, bounds = K.words(data, offsets)
    h, first, back = np.unique(K.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    size = e - s
    gb = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(s - gb[:-1], size) + np.arange(gb[-1])
    low = K.VALUE[data]
    here = low[at]
    last = np.zeros(len(at), bool)
    last[gb[1:] - 1] = True
    start = np.zeros(len(at), bool)
    start[gb[:-1]] = True
    before = np.where(start, _U(1), low[np.maximum(at - 1, 0)])
    after = np.where(last, _U(2), low[np.minimum(at + 1, max(len(data) - 1, 0))]) if len(at) else here
    grams = (K.mix(here + before * _U(5) + after * _U(11)) % _U(CHAR_SLOTS)).astype(np.int64)
    return Text(h, grams, gb, back, bounds)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of every window; a row of up to WINDOW words has one, an empty row none."""
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[row] + np.minimum(k * STRIDE, np.maximum(n[row] - WINDOW, 0))
    return first, row


class Network:
    """Parameters and passes of the network; ``vocabulary`` holds sorted word hashes, row 0 of ``word`` is the unknown."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        w = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": 0.3 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM)).astype(np.float32), "char": 0.3 * rng.standard_normal((CHAR_SLOTS, CHAR_DIM)).astype(np.float32)}
        for k in "fb":
            self.p |= {f"x{k}": w(d, 3 * HIDDEN), f"h{k}": w(HIDDEN, 3 * HIDDEN), f"b{k}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"att": w(2 * HIDDEN, HIDDEN), "query": w(HIDDEN, 1)[:, 0], "out": w(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, t: Text) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors of the distinct words, and their word ids."""
        ids = self.ids(t.hashes)
        if not len(ids):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32), ids
        chars = np.add.reduceat(self.p["char"][t.grams], t.gram_bounds[:-1], axis=0) / np.diff(t.gram_bounds)[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][ids], chars), axis=1), ids

    def run(self, gates: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows (rows of ``index`` into the gate inputs, -1 where ``mask`` is 0)."""
        n, cache = len(index), {}
        whole = bool(mask.all())
        safe = index if whole else np.where(mask, index, 0)
        states = np.empty((n, WINDOW, 2 * HIDDEN), np.float32)
        for k, side in (("f", 0), ("b", HIDDEN)):
            h = np.zeros((n, HIDDEN), np.float32)
            u = self.p[f"h{k}"]
            for t in range(WINDOW) if k == "f" else range(WINDOW - 1, -1, -1):
                x = gates[k][safe[:, t]]
                hu = h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = h + z * (c - h)
                if not whole:
                    new = np.where(mask[:, t : t + 1], new, h)
                if keep:
                    cache[k, t] = (h, z, r, c, hu)
                states[:, t, side : side + HIDDEN] = h = new
        a = np.tanh(states @ self.p["att"])
        e = a @ self.p["query"]
        e = e if whole else np.where(mask, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        pooled = (e[:, None] @ states)[:, 0]
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (cache, states, a, e, pooled)) if keep else logit

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {k: x @ self.p[f"x{k}"] + self.p[f"b{k}"] for k in "fb"}

    def logits(self, t: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, first word and row of every window of a run of rows."""
        first, row = windows(t.bounds)
        out = np.zeros(len(first), np.float32)
        if not len(first):
            return out, first, row
        g = self.gates(self.inputs(t)[0])
        for lo in range(0, len(first), SIDE):
            at = first[lo : lo + SIDE, None] + np.arange(WINDOW)
            mask = at < t.bounds[row[lo : lo + SIDE] + 1][:, None]
            out[lo : lo + SIDE] = self.run(g, t.word[np.where(mask, at, 0)], mask)
        return out, first, row

    def gradients(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted log loss: of the parameters, and of the inputs ``x``."""
        g = self.gates(x)
        logit, (cache, states, a, e, pooled) = self.run(g, index, mask, keep=True)
        d = ((_sigmoid(logit) - label) * weight).astype(np.float32)
        out = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["out"]
        ds = e[:, :, None] * dp[:, None]
        de = (states * dp[:, None]).sum(axis=2)
        de = e * (de - (e * de).sum(axis=1, keepdims=True))
        out["query"] = (a * de[:, :, None]).sum(axis=(0, 1))
        da = de[:, :, None] * self.p["query"] * (1 - a * a)
        out["att"] = states.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, HIDDEN)
        ds += da @ self.p["att"].T
        dx = np.zeros_like(x)
        safe = np.where(mask, index, 0)
        for k, side in (("f", 0), ("b", HIDDEN)):
            u, dg = self.p[f"h{k}"], np.zeros_like(g[k])
            du, dh = np.zeros_like(u), np.zeros((len(index), HIDDEN), np.float32)
            for t in range(WINDOW - 1, -1, -1) if k == "f" else range(WINDOW):
                h, z, r, c, hu = cache[k, t]
                on = mask[:, t : t + 1]
                total = dh + ds[:, t, side : side + HIDDEN]
                moved = np.where(on, total, 0)
                dc = moved * z * (1 - c * c)
                dz = moved * (c - h) * z * (1 - z)
                dr = dc * hu[:, 2 * HIDDEN :] * r * (1 - r)
                dhu = np.concatenate((dz, dr, dc * r), axis=1)
                du += h.T @ dhu
                dh = np.where(on, total * (1 - z), total) + dhu @ u.T
                np.add.at(dg, safe[:, t], np.concatenate((dz, dr, dc), axis=1))
            out[f"h{k}"], out[f"b{k}"], out[f"x{k}"] = du, dg.sum(axis=0), x.T @ dg
            dx += dg @ self.p[f"x{k}"].T
        return out, dx


def train(texts: list[str], labels: np.ndarray, seed: int = 5) -> Network:
    """Fit a network on texts with 0/1 labels."""
    rng = np.random.default_rng(seed)
    raw = pa.array(texts, pa.large_string())
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[: len(texts) + 1] if texts else np.zeros(1, np.int64)
    t = read(data, offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(t.bounds))
    seen = np.unique(t.word * len(texts) + row) if len(row) else np.zeros(0, np.int64)
    w, r = seen // max(len(texts), 1), seen % max(len(texts), 1)
    pos = np.bincount(w, labels[r], minlength=len(t.hashes))
    neg = np.bincount(w, 1 - labels[r], minlength=len(t.hashes))
    often = pos + neg >= 2
    if often.sum() > MAX_WORDS:
        often &= pos + neg >= np.sort((pos + neg)[often])[-MAX_WORDS]
    net = Network(np.sort(t.hashes[often]), seed)
    odds = _strength(pos, neg, labels.sum(), (1 - labels).sum())
    # A word's vector starts with its strength, so that little data goes far.
    net.p["word"][net.ids(t.hashes[np.isin(t.hashes, net.vocabulary)]), 0] = np.clip(odds[np.isin(t.hashes, net.vocabulary)] / 3, -1.5, 3)
    first, wrow = windows(t.bounds)
    if not len(first) or labels.min(initial=1) == labels.max(initial=0):
        net.p["bias"][:] = 3.0 if len(labels) and labels.min() == 1 else -3.0
        return net
    at = first[:, None] + np.arange(WINDOW)
    mask = at < t.bounds[wrow + 1][:, None]
    index = t.word[np.where(mask, at, 0)]
    strength = np.where(mask, odds[index], -99.0).max(axis=1)
    clean = np.flatnonzero(labels[wrow] == 0)
    toxic_rows = np.flatnonzero((labels == 1) & (np.diff(t.bounds) > 0))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    bound = np.searchsorted(wrow, np.arange(len(texts) + 1))
    for round_ in range(ROUNDS):
        # The strongest windows of each toxic text are positives; clean windows that look worst are shown more often.
        best = np.array([bound[i] + strength[bound[i] : bound[i + 1]].argmax() for i in toxic_rows])
        sure = best[strength[best] >= min(SURE, np.median(strength[best]))] if round_ == 0 else best
        hard = clean[np.argsort(-strength[clean])[: 4 * len(best) + BATCH]]
        for _ in range(int(min(STEPS, 20 + len(sure)))):
            pick = np.concatenate((rng.choice(sure, BATCH // 3), rng.choice(clean, BATCH // 3), rng.choice(hard, BATCH // 3)))
            words, local = np.unique(index[pick], return_inverse=True)
            sizes = np.diff(t.gram_bounds)[words]
            grams = t.grams[np.repeat(t.gram_bounds[words] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())]
            sub = Text(t.hashes[words], grams, np.concatenate(([0], np.cumsum(sizes))), local, np.zeros(1, np.int64))
            x, ids = net.inputs(sub)
            y = (labels[wrow[pick]]).astype(np.float32)
            grads, dx = net.gradients(x, local.reshape(index[pick].shape), mask[pick], y, np.full(len(pick), 1 / len(pick), np.float32))
            grads["word"] = np.zeros_like(net.p["word"])
            np.add.at(grads["word"], ids, dx[:, :WORD_DIM])
            grads["char"] = np.zeros_like(net.p["char"])
            np.add.at(grads["char"], grams, np.repeat(dx[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        strength = net.logits(t)[0]
    top = np.array([strength[bound[i] : bound[i + 1]].max(initial=-20.0) for i in range(len(texts))])
    net.scale, net.shift = _calibrate(np.clip(top, -20, 20), labels)
    return net


def _strength(pos: np.ndarray, neg: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Signed root of the log-likelihood ratio of each word's document counts in toxic and clean texts."""
    n1, n0 = max(n1, 1), max(n0, 1)
    share = (pos + neg) / (n1 + n0)
    ratio = lambda k, n: k * np.log(np.maximum(k, 1e-9) / np.maximum(n * share, 1e-9)) + (n - k) * np.log(np.maximum(n - k, 1e-9) / np.maximum(n * (1 - share), 1e-9))
    return np.sign(pos / n1 - neg / n0) * np.sqrt(2 * np.maximum(ratio(pos, n1) + ratio(neg, n0), 0))


def _calibrate(top: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the label on a text's highest window, by Newton steps with a ridge towards slope 1, shift 0."""
    x = np.stack((top, np.ones(len(top))), 1).astype(float)
    start, ridge = np.array([1.0, 0.0]), np.array([1e-2, 1e-4]) * len(x)
    w = start
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w + 0.5 * np.linalg.solve(h, x.T @ (labels - p) - ridge * (w - start))
    return float(max(w[0], 1e-3)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, salt: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Train on at most ``SAMPLE`` rows of ``labels`` (id, label), those of smallest ``salt`` (of the id), and about ``SAMPLE_BYTES`` of text.

    Ids are chosen first; only their texts are fetched, by a broadcast of at most ``SAMPLE`` rows, and come to the driver.  Of a clean text of more
    than ``LONGEST`` characters a run of that length is read; toxic ones of that length are left out, as a run may miss what makes them toxic.
    Null labels and texts teach nothing.  Without rows of both labels all scores are the same."""
    chosen = bounded_sample(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null"), salt, SAMPLE)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")
    start = 1 + F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - LONGEST, F.lit(1)))
    rows = rows.where((F.length("text") <= LONGEST) | (F.col("label") == 0)).withColumn("text", F.when(F.length("text") > LONGEST, F.substr("text", start.cast("int"), F.lit(LONGEST))).otherwise(F.col("text")))
    rows = saved(rows, "toxicity-sample")
    # Texts of ids that repeat may be more than the labels.
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    most = int(min(SAMPLE, n, n * SAMPLE_BYTES / max(size, 1)))
    few = bounded_sample(rows, F.xxhash64("id", "text"), max(1, most)).toArrow().to_pandas().sort_values(["id", "text"])
    discard(rows)
    return train(few["text"].tolist(), few["label"].to_numpy(float))


def score(docs: DataFrame, model: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 if score >= 0.5).

    Whole texts are scored, every row by its text alone; a text that is null or without words has the score of the lowest window logit.
    Columns of ``docs`` that are named like the two are replaced.  An empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list[pa.Array]:
        net, top = sent.value, np.full(len(texts), -20.0)
        for first, data, offsets in K.slices(texts, 1 << 20):
            logit, _, row = net.logits(read(data, offsets))
            np.maximum.at(top, first + row, logit)
        score = _sigmoid(net.scale * np.clip(top, -20, 20) + net.shift)
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return annotated(docs, text_col, run, "score double, predicted int")
