"""Connected components of the exact Jaccard self-join of word shingle sets, by universe-partition pigeonhole (after Deng et al., VLDB 2016).

Two sets with Jaccard similarity >= 3/4 differ in at most (a + b) / 7 elements.  Sizes fall into bands whose bounds
grow by 4/3, so a linked pair's larger set lies in the band of the smaller one or the next.  A band has a *scheme*: the hash
universe is cut into more segments than a pair of that band can have differences, so some segment holds the same
subset on both sides.  Each document indexes the subsets of its non-empty segments in the scheme of its own band and
of the next.

Segments that are empty cannot be indexed, so a document may have fewer usable segments than differences to survive.  The
allocation is then widened at the least cost: such a document also indexes the one-deletion neighbourhoods of its segments
(budget 2 instead of 1 for every segment of two or more shingles), and if even that is too little, its single
shingles.  Since a document with enough segments finds all its partners, these extra keys only have to meet among
documents that lack segments.  The smallest sets, whose pairs differ in one shingle at most, have one segment with all its
one-deletion neighbourhoods, so no key of theirs is a single frequent shingle.

The rest of the allocation is by cost, and the cost of a key is the number of its owners: a document shares at least ``need`` keys with
any partner, so its ``need - 1`` most frequent keys get no budget.  The order (owners, key) is the same for all documents, so the rarest key
that two partners share is kept by both: no candidate is lost, and frequent passages cost only the documents that have little else.

Candidates are resolved without listing all pairs of a group: equal sets form one class first, and keys with the same
classes one key; in a few rounds every key that touches several components links its members to one of them, those pairs
are verified (a parity sketch first, then exactly) and components formed; only keys that still touch several components are compared
all-against-all, in blocks inside the tasks, pairs of different components only, filtered by the
sketch, whose bit difference never exceeds the true one; what passes is verified exactly too.  Only components are computed: pairs inside
a component are not sought, so there is no table of all linked pairs and no number of links of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import block_pairs, bounded_sample, components, discard, map_arrow, saved

#: Segments beyond the number needed, as a factor; keys buffered by a task; keys meant for one bucket; rows of a block.
SLACK, FLUSH, BUCKET_KEYS, BLOCK = 1.15, 500_000, 500_000, 1024
#: Texts sampled to find keys of many owners; such a key occurs in this many of them (0.2 %).  The sample only decides how keys are dealt.
SAMPLE, HOT = 5000, 10
#: Bytes of a class's name sent with its keys; keys of a class in one tag.  Classes of equal names are all candidates of the keys they share
#: with others, and of each other: their name is a key of its own.
NAME_BYTES, MOST = 6, 127
#: Bits of the parity sketch for each shingle; rows meant for one task of the all-against-all pass; pairs compared at once.
SKETCH, PART_ROWS, SIDE = 4, 40_000, 100_000
#: Rounds in which every open key links its members to one of them, another in each round.
STARS = 2

_U = np.uint64


def bands(top: int) -> list[int]:
    """Lower bounds of the size bands that cover sizes 1..top, and the one after."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * 4 // 3 + 1)
    return [*out, out[-1] * 4 // 3 + 1, 1 << 62]


_BANDS = bands(1 << 40)


def segments(band: int) -> int:
    """Number of segments of a band's scheme."""
    most = 2 * (_BANDS[band + 1] - 1) // 7
    return 1 if most <= 1 else int((most + 1) * SLACK) + 1


def _salt(*parts: int) -> np.uint64:
    x = np.array([0], np.uint64)
    for p in parts:
        x = K.mix(x + np.array([p + 1], np.uint64))
    return x[0]


def keys_of(s: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Of one sorted distinct shingle set, in the scheme of its own band and of the next: candidate keys, and how many of them the
    set shares at least with any partner (segments in use beyond the differences a partner may have; 1 after widening)."""
    n = len(s)
    if not n:
        return [np.zeros(0, np.uint64)] * 2, [1, 1]
    own = int(np.searchsorted(_BANDS, n, "right")) - 1
    schemes, need = [], []
    high = s >> _U(32)
    for band in (own, own + 1):
        out = [np.zeros(0, np.uint64)]
        # The larger set of a pair in this scheme has at most this size.
        partner = min(4 * n // 3, _BANDS[band + 1] - 1)
        if partner < _BANDS[band]:
            schemes.append(out[0])
            need.append(1)
            continue
        differ = (n + partner) // 7
        m = segments(band)
        part = (high * _U(m)) >> _U(32)  # segments are ranges of the hash, so they are already in order
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.add.reduceat(K.mix(s), at)
        base = K.mix(part[at] + _salt(band, m))
        out.append(K.mix(sums + base))
        if len(at) > differ:
            schemes.append(np.unique(out[1]))
            need.append(len(at) - differ)
            continue
        counts = np.diff(np.concatenate((at, [n])))
        less = np.repeat(sums, counts) - K.mix(s)  # each segment without one of its shingles
        many = np.repeat(counts > 1, counts)
        short = K.mix(np.repeat(base, counts)[many] + less[many] + _salt(band, m, 1))
        out += [short, K.mix(sums + base + _salt(band, m, 1))]
        if (counts == 1).sum() + 2 * (counts > 1).sum() <= differ:
            out.append(K.mix(s + _salt(band, m, 2)))
        schemes.append(np.unique(np.concatenate(out)))
        need.append(1)
    return schemes, need


def needs(s: np.ndarray) -> list[int]:
    """The second value of :func:`keys_of`, without the keys."""
    n, out = len(s), []
    if not n:
        return [1, 1]
    own = int(np.searchsorted(_BANDS, n, "right")) - 1
    for band in (own, own + 1):
        partner = min(4 * n // 3, _BANDS[band + 1] - 1)
        part = ((s >> _U(32)) * _U(segments(band))) >> _U(32)
        spare = 1 + int(np.count_nonzero(part[1:] != part[:-1])) - (n + partner) // 7
        out.append(spare if partner >= _BANDS[band] and spare > 0 else 1)
    return out


def class_of(s: np.ndarray) -> int:
    """64-bit name of a set, as a signed integer."""
    return int(K.mix(np.array([K.mix(K.mix(s)).sum(dtype=np.uint64) + _U(len(s))], np.uint64)).view(np.int64)[0])


def _fingerprints(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Size, two names and needs of the set of every text."""
    n, h1, h2, need0, need1 = (np.zeros(batch.num_rows, np.int64) for _ in range(5))
    for i, s in K.shingle_sets(batch["text"]):
        n[i], h1[i] = len(s), class_of(s)
        h2[i] = class_of(K.mix(s + _U(11)))
        need0[i], need1[i] = needs(s)
    yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], *map(pa.array, (n, h1, h2, need0, need1))], ["row", "id", "n", "h1", "h2", "need0", "need1"])


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Keys of the texts of a batch and how many of the texts have them."""
    for first in range(0, batch.num_rows, 64):
        sets = [np.unique(np.concatenate(keys_of(s)[0])) for _, s in K.shingle_sets(batch["text"].slice(first, 64))]
        key, n = np.unique(np.concatenate(sets), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])


def hot_keys(source: DataFrame) -> np.ndarray:
    """Keys that occur in ``HOT`` of ``SAMPLE`` texts or more, sorted; no more than the sample's keys divided by ``HOT``."""
    sample = bounded_sample(source.select("row", "text"), F.xxhash64("row"), SAMPLE).select("text").distinct()
    counts = map_arrow(sample, _counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    return np.sort(np.array([r["key"] for r in counts.select("key").collect()], np.int64).view(np.uint64))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, keys)
    return known[np.minimum(at, len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def _keys(buckets: int, hot: np.ndarray):
    """Rows (bucket, keys, names, tags): the lower key halves of a run of classes that fall into a bucket, ordered by class and
    scheme; for each class and scheme the lower bytes of the class's name and a byte with the scheme (high bit) and number of keys.

    A key goes to the bucket of its upper half, so all its owners meet.  The owners of a ``hot`` key do not: they are dealt by key and class over
    as many further buckets, from number ``buckets``."""
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "names", "tags"))])

    def flush(names: list[int], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        owner = np.repeat(np.arange(len(keys), dtype=np.int64), [len(k) for k in keys])  # 2 * class + scheme
        key = np.concatenate(keys)
        place = key >> _U(32)
        dealt = _among(key, hot)
        who = np.array(names, np.int64).view(np.uint64)[owner[dealt] >> 1] & _U((1 << 8 * NAME_BYTES) - 1)
        place[dealt] = K.mix((key[dealt] & _U(0xFFFFFFFF)) + K.mix(who)) >> _U(32)
        bucket = ((place * _U(buckets)) >> _U(32)).astype(np.int32) + np.int32(buckets) * dealt.astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, key, owner = bucket[order], key[order].astype(np.uint32), owner[order]
        fresh = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]))))
        held = np.diff(np.append(fresh, len(key)))
        parts = -(-held // MOST)
        count = np.full(parts.sum(), MOST, np.int64)
        count[np.cumsum(parts) - 1] = held - MOST * (parts - 1)
        who, place = np.repeat(owner[fresh], parts), np.repeat(bucket[fresh], parts)
        name = np.array(names, np.int64)[who >> 1].view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]
        tag = (count + 128 * (who & 1)).astype(np.uint8)
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        to = np.append(at[1:], len(key))
        lo, hi = np.searchsorted(place, bucket[at]), np.searchsorted(place, bucket[at], "right")
        for i in range(0, len(at), 4096):
            pick = range(i, min(i + 4096, len(at)))
            rows = [key[at[x] : to[x]].tobytes() for x in pick], [name[lo[x] : hi[x]].tobytes() for x in pick], [tag[lo[x] : hi[x]].tobytes() for x in pick]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at[pick]]), *(pa.array(r, pa.binary()) for r in rows)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int] = []
        keys: list[np.ndarray] = []
        seen, held = set(), 0
        for batch in batches:
            for _, s in K.shingle_sets(batch["text"]):
                if not len(s) or (name := class_of(s)) in seen:
                    continue
                seen.add(name)
                names.append(name)
                own, _ = keys_of(s)
                keys += own
                held += len(own[0]) + len(own[1])
                if held >= FLUSH:
                    yield from flush(names, keys)
                    names, keys, seen, held = [], [], set(), 0
        yield from flush(names, keys)

    return run


def _shared(buckets: int):
    """Of one bucket: the keys that several classes have, with their classes.  ``f``: owners of the key; ``w``: keys of the class that this row
    stands for, of all keys with the same classes and of those that agree in the bits sent.

    Of a bucket of hot keys: all its keys and classes once, with ``f`` -1 for the first row of a key and class, 0 for its other scheme."""
    columns = ["key", "name", "scheme", "w", "f"]

    def hot(table: pa.Table) -> pa.Table:
        key, name, scheme, own = _own(*_owners(table))
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        made = key.astype(np.int64), name, scheme.astype(np.int32), own, -first.astype(np.int64)
        return pa.table([pa.array(c) for c in made], names=columns)

    def run(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() >= buckets:
            return hot(table)
        return pa.table([pa.array(c) for c in _several(*_owners(table))], names=columns)

    return run


def _owners(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Key, class, scheme and run of every key in a bucket."""
    keys, names, schemes, runs = [], [], [], []
    for run, (k, c, t) in enumerate(zip(*(table[f].to_pylist() for f in ("keys", "names", "tags")), strict=True)):
        tag = np.frombuffer(t, np.uint8)
        name = np.zeros((len(tag), 8), np.uint8)
        name[:, :NAME_BYTES] = np.frombuffer(c, np.uint8).reshape(-1, NAME_BYTES)
        keys.append(np.frombuffer(k, np.uint32))
        names.append(np.repeat(name.view(np.int64)[:, 0], tag & 127))
        schemes.append(np.repeat(tag >> 7, tag & 127))
        runs.append(np.full(len(keys[-1]), run, np.int32))
    return tuple(np.concatenate(x) for x in (keys, names, schemes, runs))


def _own(key: np.ndarray, name: np.ndarray, scheme: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key, class and scheme once, sorted, with the number of the class's keys that agree in the bits sent."""
    order = np.lexsort((run, scheme, name, key))
    key, name, scheme, run = key[order], name[order], scheme[order], run[order]
    # One row for a key, class and scheme, with the number of the class's keys that agree in the bits sent.  Copies of a text in other
    # runs send the same keys again, so the largest number counts.
    at, own = _runs(key, name, scheme, run)
    key, name, scheme = key[at], name[at], scheme[at]
    at, _ = _runs(key, name, scheme)
    return key[at], name[at], scheme[at], np.maximum.reduceat(own, at) if len(at) else own


def _several(key: np.ndarray, name: np.ndarray, scheme: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns of :func:`_shared` for the keys that several classes have; keys with the same classes are one."""
    order = np.argsort(key, kind="stable")
    counts = _runs(key[order])[1]
    many = order[np.repeat(counts > 1, counts)]
    key, name, scheme, own = _own(key[many], name[many], scheme[many], run[many])
    at, counts = _runs(key)
    fresh = np.concatenate(([0], np.cumsum(np.concatenate((np.zeros(min(1, len(key)), np.int64), (key[1:] == key[:-1]) & (name[1:] != name[:-1]))))))
    owners = 1 + fresh[at + counts] - fresh[at]
    at, counts, owners = at[owners > 1], counts[owners > 1], owners[owners > 1]
    # Keys with the same classes become one, named by a hash of its classes.
    total = np.concatenate(([_U(0)], np.cumsum(K.mix(K.mix(name.view(np.uint64)) + scheme.astype(np.uint64)), dtype=np.uint64)))
    group, inverse = np.unique(K.mix(total[at + counts] - total[at]), return_inverse=True)
    take = np.repeat(at - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    key, name, scheme, w, f = np.repeat(group[inverse], counts), name[take], scheme[take], own[take], np.repeat(owners, counts)
    order = np.lexsort((scheme, name, key))
    key, name, scheme, w, f = (x[order] for x in (key, name, scheme, w, f))
    at, _ = _runs(key, name, scheme)
    w = np.add.reduceat(w, at) if len(at) else w
    return key[at].view(np.int64), name[at], scheme[at].astype(np.int32), w, f[at]


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal rows."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(fresh)
    return at, np.diff(np.append(at, n))


def _sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows, sets = [], []
    for i, s in K.shingle_sets(batch["text"]):
        rows.append(i)
        sets.append(s.view(np.int64))
    yield pa.RecordBatch.from_arrays([batch["rep"].take(pa.array(rows)), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])


def sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of shingles that hash to each bit: two sketches differ in no more bits than the sets."""
    odd = np.bincount((K.mix(s ^ _U(0x5851F42D4C957F2D)) >> _U(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _sketched(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows, sizes, out = [], [], []
    for i, s in K.shingle_sets(batch["text"]):
        band = int(np.searchsorted(_BANDS, len(s), "right")) - 1
        rows.append(i)
        sizes.append(len(s))
        # In the widths of the two schemes in which the set can meet a partner.
        out.append([sketch(s, 64 * -(-SKETCH * _BANDS[b + 1] // 64)).tobytes() for b in (band, band + 1)])
    at = pa.array(rows)
    yield pa.RecordBatch.from_arrays([batch["rep"].take(at), pa.array(sizes, pa.int64()), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["rep", "n", "sketch0", "sketch1"])


def _apart(flat: np.ndarray, at: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of the sketches i and j; 0, which rules nothing out, where their widths differ."""
    out = np.zeros(len(i), np.int64)
    for width in np.unique(length[i]):
        pick = np.flatnonzero((length[i] == width) & (length[j] == width))
        cols = np.arange(width)
        for lo in range(0, len(pick), max(1, SIDE * 8 // max(1, int(width)))):
            p = pick[lo : lo + max(1, SIDE * 8 // max(1, int(width)))]
            out[p] = np.bitwise_count(flat[at[i[p]][:, None] + cols] ^ flat[at[j[p]][:, None] + cols]).sum(axis=1)
    return out


def _flat(*columns: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sketches of the columns in one array of words: the words, each sketch's start and length."""
    raw = [x for c in columns for x in c.to_pylist()]
    length = np.array([len(x) // 8 for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint64), np.cumsum(length) - length, length


def _possible(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pairs of a batch that their sketches leave possible."""
    n = len(batch)
    flat, at, length = _flat(batch["su"], batch["sv"])
    apart = _apart(flat, at, length, np.arange(n), n + np.arange(n))
    keep = pa.array(np.flatnonzero(7 * apart <= batch["nu"].to_numpy() + batch["nv"].to_numpy()))
    yield pa.RecordBatch.from_arrays([batch["u"].take(keep), batch["v"].take(keep)], ["u", "v"])


def _crossing(table: pa.Table) -> pa.Table:
    """Of the blocks dealt to a part: pairs of different components that sizes and sketches leave possible."""
    cols = ("key", "block_i", "block_j", "rep", "n", "root", "chunk")
    key, bi, bj, rep, n, root, chunk = (table[c].to_numpy() for c in cols)
    order = np.lexsort((rep, bj, bi, key))
    key, bi, bj, rep, n, root, chunk = (x[order] for x in (key, bi, bj, rep, n, root, chunk))
    flat, at, length = _flat(table["sketch"])
    at, length = at[order], length[order]
    end = np.flatnonzero(np.concatenate(((key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]), [True]))) + 1
    last = np.repeat(end, np.diff(np.concatenate(([0], end))))  # where each row's block ends
    found, rows, step = [], np.arange(len(key)), 1
    while True:
        i = rows[rows + step < last[rows]]
        if not len(i):
            break
        j, rows, step = i + step, i, step + 1
        ok = (root[i] != root[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & ((bi[i] == bj[i]) | (chunk[i] != chunk[j]))
        i, j = i[ok], j[ok]
        near = 7 * _apart(flat, at, length, i, j) <= n[i] + n[j]
        found.append(np.stack((np.minimum(rep[i], rep[j])[near], np.maximum(rep[i], rep[j])[near]), 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table({"u": pa.array(pairs[:, 0].copy()), "v": pa.array(pairs[:, 1].copy())})


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar enough; only texts of classes in a pair are shingled again."""
    pairs = saved(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
    sets = saved(map_arrow(texts.join(asked, "rep", "left_semi").select("rep", "text"), _sets, "rep long, shingles array<long>"), "sets")
    a = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    met = pairs.join(a, "u").join(b, "v").select("u", "v", both.alias("both"), (F.size("a") + F.size("b")).alias("sum"))
    found = saved(met.where("100L * both >= 75L * (sum - both)").select("u", "v"), "links")
    discard(pairs, sets)
    return found


def _still_open(rows: DataFrame) -> DataFrame:
    """The rows of keys that touch several components."""
    # The keys are saved, so that Spark can split a key of many rows in the join.
    keys = saved(rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "open-keys")
    out = saved(rows.join(keys, "key", "left_semi"), "open")
    discard(keys)
    return out


def _with_sketches(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those whose sizes fit, with both sizes and sketches; sketches travel only with these pairs."""
    left, right = (sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch0").alias(f"{x}0"), F.col("sketch1").alias(f"{x}1")) for x in ("u", "v"))
    sized = pairs.join(left.select("u", "nu"), "u").join(right.select("v", "nv"), "v").where("4 * least(nu, nv) >= 3 * greatest(nu, nv)")
    # Of a class's two sketches the one in the width of the pair's scheme, that of the larger set's band.
    bounds = F.array(*[F.lit(b) for b in _BANDS[:64]])
    band = lambda n: F.size(F.filter(bounds, lambda b: b <= n))
    sized = sized.withColumn("up", band(F.col("nu")) - band(F.col("nv")))
    sized = sized.join(left.drop("nu"), "u").select("u", "v", "nu", "nv", "up", F.when(F.col("up") < 0, F.col("u1")).otherwise(F.col("u0")).alias("su"))
    return sized.join(right.drop("nv"), "v").select("u", "v", "nu", "nv", "su", F.when(F.col("up") > 0, F.col("v1")).otherwise(F.col("v0")).alias("sv"))


def _dealt(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of open keys dealt into blocks, and these into parts of about ``PART_ROWS`` dealt rows, whatever the size of a key."""
    sizes = saved(rows.groupBy("key").agg(F.count("*").alias("size")), "key-sizes")
    met = rows.join(sizes, "key").join(sketches, "rep")
    met = met.withColumn("sketch", F.when(F.col("scheme") == 0, F.col("sketch0")).otherwise(F.col("sketch1")))
    dealt = block_pairs(met.drop("sketch0", "sketch1", "scheme"), "key", "size", "rep", BLOCK)
    # A key of N rows becomes N * ceil(N / BLOCK) dealt rows.
    total = sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / BLOCK))).first()[0] or 0
    parts = max(12, 1 + int(total) // PART_ROWS)
    return dealt.withColumn("part", F.pmod(F.xxhash64("key", "block_i", "block_j"), F.lit(parts)))


def _merged(dealt: DataFrame) -> DataFrame:
    """The rows of :func:`_shared` with hot keys like the others: owners counted over all their buckets, keys with the same classes made one."""
    dealt = saved(dealt, "dealt")
    hot = dealt.where("f <= 0")
    of_key = saved(hot.groupBy("key").agg((-F.sum("f")).alias("owners"), F.bit_xor(F.xxhash64("name", "scheme")).alias("classes")).where("owners > 1"), "hot-keys")
    hot = hot.join(of_key, "key").select(F.xxhash64("classes", "owners").alias("key"), "name", "scheme", "w", F.col("owners").alias("f"))
    out = saved(dealt.where("f > 0").unionAll(hot).groupBy("key", "name", "scheme").agg(F.sum("w").alias("w"), F.max("f").alias("f")), "shared")
    discard(dealt, of_key)
    return out


def _candidates(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, scheme, rep) left by the allocation: of each class's keys all but the ``need - 1`` most frequent."""
    named = classes.select("rep", F.col("h1").bitwiseAND(F.lit((1 << 8 * NAME_BYTES) - 1)).alias("name"), "need0", "need1")
    owned = shared.join(named, "name")
    # Keys of a class, bounded by the size of its set; the key itself breaks ties, the same way for all classes.
    upto = Window.partitionBy("name", "rep", "scheme").orderBy(F.desc("f"), "key").rowsBetween(Window.unboundedPreceding, 0)
    need = F.when(F.col("scheme") == 0, F.col("need0")).otherwise(F.col("need1"))
    rows = owned.withColumn("upto", F.sum("w").over(upto)).where(F.col("upto") >= need).select("key", "scheme", "rep")
    # Classes whose names agree in the bytes sent look like one class above; they are candidates of each other here.
    twins = named.groupBy("name").agg(F.count("*").alias("k")).where("k > 1")
    met = named.join(twins, "name").select(F.xxhash64(F.lit(48), "name").alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("scheme"), "rep")
    return rows.unionAll(met)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles`` (size of its set of five-word shingles) and ``component_id``, the
    smallest id reachable over links of Jaccard similarity 0.75 or more, itself included.

    Every row is a document of its own, also where ids repeat or are null: rows of one id are linked only if their texts are.  A row of null id
    has the smallest id it reaches as its component, null if there is none.  Texts that are null or hold no word have an empty set and
    link with nothing; with one to four words the whole sequence is the one shingle.  Sets are compared by 64-bit hashes of
    their shingles.  Further columns do not matter.  An empty table gives no rows."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    source = saved(source, "texts")
    prints = saved(map_arrow(source, _fingerprints, "row long, id long, n long, h1 long, h2 long, need0 long, need1 long"), "prints")
    named = prints.where("n > 0").groupBy("h1", "h2", "n")
    classes = saved(named.agg(F.min("row").alias("rep"), F.min("id").alias("low"), F.min("need0").alias("need0"), F.min("need1").alias("need1")), "classes")
    total = prints.agg(F.sum("n")).first()[0] or 0
    buckets = int(max(12, 1 + total // BUCKET_KEYS))
    blobs = source.select("text").mapInArrow(_keys(buckets, hot_keys(source)), "bucket int, keys binary, names binary, tags binary")
    shared = _merged(blobs.groupBy("bucket").applyInArrow(_shared(buckets), "key long, name long, scheme int, w long, f long"))
    rows = saved(_candidates(shared, classes).withColumn("root", F.col("rep")), "able")
    discard(shared)
    opened = _still_open(rows)
    discard(rows)
    rows = opened
    # Texts of the classes that share a key; sketches and sets are made from these.
    texts = source.join(rows.select(F.col("rep").alias("row")).distinct(), "row").select(F.col("row").alias("rep"), "text")
    texts = saved(texts, "asked")
    sketches = saved(map_arrow(texts, _sketched, "rep long, n long, sketch0 binary, sketch1 binary"), "sketches")

    links = None
    for turn in range(STARS):
        if turn:
            rows = _still_open(rows)
        lead = rows.groupBy("key").agg(F.min_by(F.struct("rep", "root"), F.struct(F.xxhash64("rep", F.lit(turn)), "rep")).alias("lead"))
        stars = rows.join(saved(lead, "lead"), "key").where("root <> lead.root").select(F.col("lead.rep").alias("u"), F.col("rep").alias("v")).distinct()
        more = _verified(map_arrow(_with_sketches(stars, sketches), _possible, "u long, v long"), texts)
        links = more if links is None else links.unionAll(more)
        roots = components(links)
        placed = rows.drop("root").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        rows = saved(placed.select("key", "scheme", "rep", F.coalesce("root", "rep").alias("root")), "rooted")

    rows = _still_open(rows)
    crossing = _dealt(rows, sketches).groupBy("part").applyInArrow(_crossing, "u long, v long").distinct()
    links = links.unionAll(_verified(crossing, texts))
    roots = components(links).select(F.col("node").alias("rep"), "root")
    # The smallest id of each component, then each row by the class of its set; saved, so that Spark can split a class of many copies.
    grown = saved(classes.select("h1", "h2", "n", "rep", "low").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")).drop("rep"), "grown")
    lowest = saved(grown.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    placed = saved(grown.join(lowest, "root").select("h1", "h2", "n", "component_id"), "placed")
    out = prints.join(placed, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    discard(source, classes, texts, sketches, grown, lowest)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
