"""Every operator against a plain version on a small table and on a table of odd rows."""

import collections
import hashlib
import re
import time
import zlib

import brute
import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratafold.llm import brown, common, jpeg, langid, lattice, mixing, ngram_join, packing, pii, queries, toxicity, url_filters

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, "one", "fr", "a"), (5, "one two three four five six", "fr", None),
    (6, "One two three four five SIX", "fr", "b"), (6, "One two three four five SIX", "fr", "b"), (7, LONG, "en", "b"), (8, LONG + "tail", "en", "b"), (9, "héé ünï 中文 \U0001f600 x", "zz", "b"),
    (10, "1234 5678 !!", "en", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in ODD], "doc_id long, text string, lang string, source string, score string, n double")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def plain_jaccard(known):
    """(id, size, component) of each row of ``known`` (id, text)."""
    got = brute.jaccard({k: t for k, (_, t) in enumerate(known)})
    low = {}
    for k, (i, _) in enumerate(known):
        low[got[k][1]] = min((x for x in (i, low.get(got[k][1])) if x is not None), default=None)
    return sorted([(i, got[k][0], low[got[k][1]] if got[k][0] else i) for k, (i, _) in enumerate(known)], key=str)


def test_jaccard(spark, docs, texts, odd):
    ids = [(1, "a b c d e f g h"), (1, "q r s t u v w"), (2, "Q R S T U V W"), (None, "a b c d e f g h"), (None, "z y x w v u"), (0, "z y x w v u"), (None, ""), (None, None), (7, "k k k k"), (None, "l l l l"), (None, "l  l l l")]
    repeated = spark.createDataFrame([(*r, 5, 1) for r in ids], "doc_id long, text string, rep int, n int")
    for frame, known in ((docs, list(texts.items())), (odd, [r[:2] for r in ODD]), (repeated, ids)):
        assert sorted(map(tuple, ngram_join.jaccard_groups(frame).collect()), key=str) == plain_jaccard(known)
    assert ngram_join.jaccard_groups(odd.limit(0)).count() == 0


def test_jaccard_with_one_line_in_every_short_text(spark):
    """A frequent passage in documents of many small sizes, among them near copies."""
    rng = np.random.default_rng(8)
    known = []
    for i in range(1800):
        words = [f"w{k}" for k in rng.integers(0, 3000, rng.integers(0, 12))]
        at = int(rng.integers(0, len(words) + 1))
        known.append((i, " ".join([*words[:at], *"please click here to continue".split(), *words[at:]])))
    for i in range(250):
        words = known[int(rng.integers(0, 1800))][1].split()
        words[-1 if i % 2 else 0] = f"x{i}"
        known.append((5000 + i, " ".join(words)))
    frame = spark.createDataFrame(known, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_groups(frame).collect()), key=str) == plain_jaccard(known)


def test_crossing_of_a_key_beyond_one_block(spark):
    """All links of a key of more than two blocks of classes are among the pairs of the all-against-all pass."""
    rng = np.random.default_rng(9)
    known = {i: " ".join(f"w{k}" for k in rng.integers(0, 500, 14)) for i in range(2300)}
    for i in range(200):
        words = known[int(rng.integers(0, 2300))].split()
        known[5000 + i] = " ".join([*words, f"x{i}"][i % 2 :])
    frame = spark.createDataFrame(list(known.items()), "rep long, text string")
    sketches = common.map_arrow(frame, ngram_join._sketched, "rep long, n long, sketch0 binary, sketch1 binary")
    # As in a common scheme: the band that all sizes here share, or its neighbour.
    band = {i: int(np.searchsorted(ngram_join._BANDS, len(brute.shingle_set(t)), "right")) - 1 for i, t in known.items()}
    top = max(band.values())
    rows = spark.createDataFrame([(7, 0 if b == top else 1, i, i) for i, b in band.items() if b >= top - 1], "key long, scheme int, rep long, root long")
    got = {tuple(r) for r in ngram_join._dealt(rows, sketches).groupBy("part").applyInArrow(ngram_join._crossing, "u long, v long").collect()}
    sets = {i: brute.shingle_set(t) for i, t in known.items() if band[i] >= top - 1}
    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = {(min(a, b), max(a, b)) for ids in index.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    links = {(a, b) for a, b in pairs if a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(links) > 100 and links <= got


def test_classes_of_equal_names_are_candidates(spark):
    low = (1 << 8 * ngram_join.NAME_BYTES) - 1
    classes = spark.createDataFrame([(1, 5, 1, 1), (2, 5 + low + 1, 1, 1), (3, 6, 1, 1)], "rep long, h1 long, need0 long, need1 long")
    shared = spark.createDataFrame([], "key long, name long, scheme int, w long, f long")
    got = ngram_join._candidates(shared, classes).collect()
    assert sorted((r.scheme, r.rep) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2)] and len({r.key for r in got}) == 1


def test_frequent_keys_get_no_budget(spark):
    """Of keys with 9, 5, 5 and 2 owners, a class that shares two keys with any partner at least gives up the first only."""
    classes = spark.createDataFrame([(1, 11, 2, 1)], "rep long, h1 long, need0 long, need1 long")
    shared = spark.createDataFrame([(100, 11, 0, 1, 9), (101, 11, 0, 1, 5), (102, 11, 0, 2, 5), (103, 11, 0, 1, 2), (104, 11, 1, 1, 9)], "key long, name long, scheme int, w long, f long")
    assert sorted(r.key for r in ngram_join._candidates(shared, classes).collect()) == [101, 102, 103, 104]


def test_shared_keys(spark):
    """Keys of one class that agree in the bits sent count as many, copies in another run do not; schemes stay apart."""
    name = lambda *xs: b"".join(int(x).to_bytes(8, "little")[: ngram_join.NAME_BYTES] for x in xs)
    keys = lambda *xs: np.array(xs, np.uint32).tobytes()
    table = pa.table({"bucket": [0, 0, 0], "keys": [keys(7, 7, 9, 7), keys(7, 7, 9), keys(7, 8)], "names": [name(1, 1), name(1), name(2)], "tags": [bytes([3, 128 + 1]), bytes([3]), bytes([2])]})
    got = {(r["name"], r["scheme"]): (r["w"], r["f"]) for r in ngram_join._shared(1)(table).to_pylist()}
    assert got == {(1, 0): (2, 2), (1, 1): (1, 2), (2, 0): (1, 2)}


def test_owners_of_hot_keys_are_dealt_apart(spark):
    """With all keys hot, half of them or none, the same keys have the same classes and numbers; only how they are dealt differs."""
    rng = np.random.default_rng(4)
    shared = "the same nine words stand in all of these texts"
    texts = [" ".join([*(f"w{k}" for k in rng.integers(0, 60, 12)), shared] if i % 2 else [shared, f"x{i % 7}", "y"]) for i in range(60)]
    frame = spark.createDataFrame([(t,) for t in [*texts, *texts[:9]]], "text string").repartition(3)
    sets = [s for _, s in ngram_join.K.shingle_sets(pa.array(texts))]
    every = np.unique(np.concatenate([k for s in sets for k in ngram_join.keys_of(s)[0]]))
    got = []
    for hot in (every[:0], every[::2], every):
        blobs = frame.mapInArrow(ngram_join._keys(5, hot), "bucket int, keys binary, names binary, tags binary")
        if len(hot) == len(every):
            assert blobs.agg(F.min("bucket")).first()[0] >= 5 and blobs.select("bucket").distinct().count() == 5
        dealt = ngram_join._merged(blobs.groupBy("bucket").applyInArrow(ngram_join._shared(5), "key long, name long, scheme int, w long, f long"))
        # Keys with the same classes are one by either way, but under other names.
        sets_of = {}
        for r in dealt.collect():
            sets_of.setdefault(r.key, []).append((r.name, r.scheme, r.w, r.f))
        weight = {}
        for rows_ in sets_of.values():
            k = (tuple(sorted((n, c) for n, c, _, _ in rows_)), rows_[0][3])
            weight[k] = weight.get(k, 0) + rows_[0][2]
        got.append(weight)
    assert len(got[0]) > 10 and got[0] == got[1] == got[2]
    assert len(ngram_join.hot_keys(frame.withColumn("row", F.monotonically_increasing_id()))) >= 3


@pytest.mark.parametrize("hot", [1, 3])
def test_jaccard_with_hot_keys(spark, docs, texts, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs).collect()} == brute.jaccard(texts)


def test_jaccard_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 400, 90)]
    texts = {}
    for i in range(160):
        words = list(base[: rng.integers(60, 90)]) if i % 3 else [f"v{k}" for k in rng.integers(0, 30, rng.integers(1, 25))]
        for _ in range(rng.integers(0, 5)):
            words[rng.integers(0, len(words))] = f"x{rng.integers(0, 10**6)}"
        texts[i] = " ".join(words)
    got = {k: (r.n_shingles, r.component_id) for k, r in rows(ngram_join.jaccard_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).items()}
    assert got == brute.jaccard(texts)


def test_crossing_parts_are_bounded(spark, monkeypatch):
    """A key of many classes is dealt over parts by its dealt rows."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "PART_ROWS", 100)
    rows = spark.range(400).selectExpr("7L as key", "0 as scheme", "id as rep", "id as root")
    sketches = spark.range(400).selectExpr("id as rep", "5L as n", "cast('' as binary) as sketch0", "cast('' as binary) as sketch1")
    dealt = ngram_join._dealt(rows, sketches)
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert sum(sizes) == 400 * 50 and max(sizes) <= 600


def test_keys_lose_no_pair():
    """Every pair at the bound shares a key, for many sizes."""
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 75, 200, 1001]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
            drop = int(rng.integers(0, n // 4 + 1))
            add = 0
            while 100 * (n - drop) >= 75 * (n + add + 1) and add < 400:
                add += 1
            if 100 * (n - drop) < 75 * (n + add):
                continue
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, add, dtype=np.int64).astype(np.uint64))))
            assert len(np.intersect1d(*(np.concatenate(ngram_join.keys_of(x)[0]) for x in (a, b)))), (n, drop, add)
            for x in (a, b):
                keys, need = ngram_join.keys_of(x)
                assert need == ngram_join.needs(x)
            both = [np.intersect1d(k, m) for k in ngram_join.keys_of(a)[0] for m in ngram_join.keys_of(b)[0]]
            assert max(len(x) for x in both) >= min(min(ngram_join.needs(a)), min(ngram_join.needs(b)))


def plain_links(vectors):
    """(links, component) of each row by all cosines; ``vectors``: rows of (id, vector or None)."""
    good = [k for k, (_, v) in enumerate(vectors) if v is not None and len(v) == 64 and np.isfinite(np.array(v, float)).all() and np.any(v)]
    x = np.stack([np.array(vectors[k][1], float) for k in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    root = brute.groups([(good[a], good[b]) for a, b in zip(*np.nonzero(near), strict=True)], range(len(vectors)))
    links = dict(zip(good, near.sum(axis=1).tolist(), strict=True))
    low = {}
    for k, (i, _) in enumerate(vectors):
        low[root[k]] = min((x for x in (i, low.get(root[k])) if x is not None), default=None)
    return [(i, links.get(k, 0), low[root[k]] if k in links else i) for k, (i, _) in enumerate(vectors)]


def test_embeddings(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").limit(60)
    rng = np.random.default_rng(0)
    found = [(int(r.vec_id), np.array(r.embedding, float)) for r in e.collect()]
    near = [(10_000 + i, v * 3 + rng.standard_normal(len(v)) * 0.02) for i, v in found[:30]]
    near += [(20_000, found[0][1]), (20_001, found[0][1]), (20_001, found[0][1]), (None, found[0][1]), (20_001, found[5][1]), (None, found[7][1] * 2), (None, rng.standard_normal(64))]
    bad = [(30_000, None), (30_001, []), (30_002, [0.0] * 64), (30_003, [float("nan")] * 64), (30_004, [None] * 64), (30_005, [1.0] * 3), (30_006, [float("inf")] * 64), (None, None), (30_000, None)]
    known = [(i, v.tolist()) for i, v in found + near]
    table = spark.createDataFrame([(*r, 1, "x") for r in known + bad], "vec_id long, embedding array<double>, n_links int, rep string")
    got = [tuple(r) for r in lattice.near_duplicates(table).collect()]
    want = [(*r, r[0] is not None and r[0] == r[2]) for r in plain_links(known)] + [(i, 0, i, i is not None) for i, _ in bad]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lattice.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_in_a_large_cell(spark):
    """A cluster of more than two blocks of rows: every link is counted once."""
    rng = np.random.default_rng(4)
    centre, other = rng.standard_normal((2, 64))
    rows = [(i, (centre * 4 + rng.standard_normal(64) * 0.9).tolist()) for i in range(2600)] + [(5000 + i, (other * 4 + rng.standard_normal(64) * 0.2).tolist()) for i in range(40)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {i: (n, c) for i, n, c in plain_links(rows)}
    total = sum(n for n, _ in want.values())
    assert total > 2_000_000 and all(got[i][0] <= n for i, (n, _) in want.items())
    assert sum(n for n, _ in got.values()) >= 0.99 * total and all(got[i][1] == want[i][1] for i in want)


@pytest.mark.parametrize("grid", [g for _, g in lattice.GRIDS])
def test_embedding_recall(spark, grid):
    """Pairs just above the threshold, where recall is least, with the grid of every size of table."""
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.96, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((x, c * x + np.sqrt(1 - c * c) * y)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(table, grid=grid).collect()}
    assert sum(got.values()) >= 0.98 * 3000 and max(got.values()) == 1


def test_no_embedding_link_is_left_out(spark, monkeypatch):
    """Pairs just above the threshold, in two lengths, chained and repeated: every link, in several broadcast blocks, while cells alone miss some."""
    rng = np.random.default_rng(6)

    def near(n, dim, low, high):
        x, y = rng.standard_normal((2, n, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        c = rng.uniform(low, high, (n, 1))
        return np.concatenate((x, c * x + np.sqrt(1 - c * c) * y))

    x = near(1200, 64, 0.95001, 0.951)
    chain = near(300, 64, 0.951, 0.96)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((x, chain, x[:5], chain[300:] * 2 + chain[:300] * 0.1)))] + [(9000 + i, v.tolist()) for i, v in enumerate(near(40, 24, 0.9502, 0.952))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(lattice, "REST_BYTES", 500_000)
    want = {i: (n, c) for i, n, c in plain_links([r for r in rows if len(r[1]) == 64])}
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(table).collect()}
    assert {i: got[i] for i in want} == want and sum(n for n, _ in want.values()) > 3000
    assert all(got[9000 + i] == (1, 9000 + i % 40) for i in range(80))
    cells = {r.vec_id: r.n_links for r in lattice.near_duplicates(table, exact=False).collect()}
    assert sum(cells.values()) < sum(n for n, _ in got.values())


def test_e8_nearest():
    """The first candidate is the nearest lattice point, checked against all half-integer points around."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 8)) * 2
    points, far = lattice.decode_e8(x)
    p = points[:, 0]
    assert ((p % 2 == 0).all(axis=1) | (p % 2 == 1).all(axis=1)).all() and (p.sum(axis=1) % 4 == 0).all()
    steps = np.array([s for s in np.stack(np.meshgrid(*[[-1, 0, 1]] * 8), -1).reshape(-1, 8)]) * 1.0
    for v, q, d in zip(x, p / 2, far[:, 0], strict=True):
        for shift in (0, 0.5):
            near = np.rint(v - shift) + steps
            near = near[near.sum(axis=1) % 2 == 0] + shift
            assert d <= ((near - v) ** 2).sum(axis=1).min() + 1e-9


def test_media(docs, texts, odd):
    for frame, known in ((docs, texts), (odd, {r[0]: r[1] for r in ODD})):
        for i, r in rows(jpeg.media(frame)).items():
            raw = (known[i] or "").encode()
            full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
            assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)


def test_jpeg_beyond_one_file():
    rng = np.random.default_rng(1)
    for n in (1, 341, 342, 9000):
        data = rng.integers(0, 256, 576 * n, dtype=np.uint8).tobytes()
        images = jpeg.thumbnails(jpeg.encode([data]))[0]
        assert b"".join(t.tobytes() for _, _, t in images) == data


def test_langid_parts_of_long_texts(monkeypatch):
    """A text handled in parts counts as one handled at once, also where a part ends inside a character or a row."""
    texts = pa.array(["héé ünï 中文 word, " * 40_000, None, "", "short one", "a b" * 100_000, "zz"])
    rng = np.random.default_rng(3)
    model = langid.LanguageFilter(["a", "b"], rng.integers(0, 4, (langid.SLOTS, 1), dtype=np.uint64), np.full(2, 0.1), np.ones(2))
    parts, n = model.rates(texts)
    monkeypatch.setattr(langid, "SLICE", 1 << 30)
    whole, m = model.rates(texts)
    assert (n == m).all() and (parts == whole).all() and n[1] == n[2] == 0 and n[0] > 1_000_000


def test_media_of_very_long_and_no_texts(spark):
    """The feature follows every file of a payload; an empty table has no rows."""
    head = "".join(chr(33 + k * 7 % 90) for k in range(576)) * 8300
    texts = [head + "a" * 576_000, head + "\x01" * 576_000]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": texts})
    out = [r for b in jpeg._media(batch) for r in b.to_pylist()]
    assert out[0]["feature"].split(":")[0] == out[1]["feature"].split(":")[0] and out[0]["feature"] != out[1]["feature"]
    assert [r["payload_sha256"] for r in out] == [hashlib.sha256(jpeg.payload(t.encode())).hexdigest() for t in texts]
    assert jpeg.media(spark.createDataFrame([], "doc_id long, text string, id int")).collect() == []


def test_jpeg_with_ac_and_colour():
    """A hand-made file: three components, two luminance blocks side by side, AC codes, no restart interval."""
    dc, ac = bytes([0, 2, *[0] * 14, 0, 3]), bytes([0, 3, *[0] * 14, 0x00, 0x12, 0xF0])
    luma = [5, -2, 4, 4]
    bits = ""
    for k, (value, last) in enumerate(zip(luma, [0, *luma], strict=False)):
        d = value - last
        bits += "00" if d == 0 else "01" + format(d if d > 0 else d + 7, "03b")
        bits += "01" + "11" + "10" + "00"  # run 1 size 2, a run of 16 zeros, end of block
        if k % 2:
            bits += "0000" * 2  # the two colour blocks
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    data = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([16] * 64)) + seg(0xC0, bytes([8, 0, 8, 0, 32, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data += seg(0xC4, bytes([0]) + dc) + seg(0xC4, bytes([0x10]) + ac) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + body + b"\xff\xd9"
    ((wide, high, thumb),) = jpeg.thumbnails([data])[0]
    assert (wide, high) == (32, 8) and thumb.tolist() == [[128 + 2 * v for v in luma]]


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mix(docs, odd):
    for frame in (docs, odd):
        got = mixing.mix(frame).collect()
        sources = {}
        for r in frame.collect():
            sources.setdefault((r.doc_id, len(WORD.findall(r.text or ""))), r.source)
        sizes, taken, seen = {}, {}, {}
        for r in got:
            s = sources[r.doc_id, r["size"]]
            sizes[s] = sizes.get(s, 0) + r["size"]
            taken[s] = taken.get(s, 0) + r.taken
            seen[s] = r
            assert 0 <= r.taken <= 2 * r["size"]
        target = plain_targets(sizes)
        for s, r in seen.items():
            assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and abs(taken[s] - target[s]) <= 1
        assert sorted(map(tuple, mixing.mix(frame.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
        out = mixing.mixed(frame)
        assert out.columns == frame.columns
        assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    clash = odd.selectExpr("doc_id", "text", "source", *[f"'{c}' as {c}" for c in ("size", "target", "taken", "finish", "source_size", "bucket", "row")])
    out = mixing.mixed(clash)
    assert out.columns == clash.columns and {(r["size"], r.target, r.row) for r in out.collect()} == {("size", "target", "row")}


def test_mix_of_repeated_rows(spark):
    """Rows equal in id and text fill cells of the usual size, and take the places of one running sum."""
    rows = [(None, "a b c", "x", i) for i in range(600)] + [(7, "d e", None, i) for i in range(300)] + [(i, f"w{i} v", "x" if i % 3 else "y", i) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    got = mixing.mix(docs, cell_rows=20).collect()
    one = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted((r.doc_id or 0, r["size"]) for r in got) == sorted((r.doc_id or 0, r["size"]) for r in one)
    for size in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == size]
        ends = sorted(round(r.finish * r.target) for r in mine)
        steps = sorted(b - a for a, b in zip([0, *ends], ends, strict=False))
        assert steps == sorted(r["size"] for r in mine) and abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, cell_rows=20).collect()))
    out = mixing.mixed(docs, cell_rows=20)
    assert out.columns == docs.columns and sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in got)
    stored = common.saved(docs.selectExpr("source as src", "xxhash64(doc_id, text) as h"), "rows")
    bucket = F.lit(0).cast("long")
    cells = mixing._cells(stored, bucket, mixing._repeated(stored.where("src is not null"), bucket, 20), 20)
    assert cells.where("hot <> 0").groupBy("hot", "share").count().agg({"count": "max"}).first()[0] <= 60


def test_brown(spark, docs, odd):
    train = docs.where("crc32(cast(doc_id as string)) % 7 <> 2")
    model, counts = brown.fit(train, "text")
    tokens = lambda t: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
    c = {}
    for r in train.collect():
        for w in tokens(r.text):
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    for frame in (docs, odd):
        known = {r.doc_id: r.text for r in frame.collect()}
        for i, r in rows(brown.score(frame, model, counts, "doc_id", "text")).items():
            t = tokens(known[i])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), n)
            assert r.base_score == pytest.approx(sum(np.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in t))
            assert r.score < 0
    held = brown.score(docs.where("crc32(cast(doc_id as string)) % 7 = 2"), model, counts, "doc_id", "text")
    sums = held.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums["s"] > sums["b"]
    model, counts = brown.fit(docs.limit(0), "text")
    assert brown.score(odd, model, counts, "doc_id", "text").count() == len(ODD)


def test_brown_codes_texts_once(spark, docs, monkeypatch):
    """The query codes its texts once, for the class bigrams and for the scores; what fit and score give apart, it gives."""
    monkeypatch.setattr(brown, "KNOWN", 500)
    sources, coded = [], brown._coded

    def counted(source, *rest):
        out = coded(source, *rest)
        sources.append(out.columns)
        return out

    monkeypatch.setattr(brown, "_coded", counted)
    monkeypatch.setattr(queries, "documents", lambda *_: docs)
    once = rows(queries.op6_brown(spark, ""))
    (columns,) = sources
    assert "words" not in columns
    model, counts = brown.fit(docs.where("crc32(cast(doc_id as string)) % 7 <> 2"), "text")
    apart = rows(brown.score(docs, model, counts, "doc_id", "text"))
    assert len(sources) == 3 and once.keys() == apart.keys() and len(model.words) <= 500 < counts.count()
    for i, r in apart.items():
        assert (once[i].n_tokens, once[i].n_known, once[i].train_tokens) == (r.n_tokens, r.n_known, r.train_tokens)
        assert (once[i].base_score, once[i].score) == pytest.approx((r.base_score, r.score))


def test_brown_clusters_by_count(spark, monkeypatch):
    """Words beyond the seeds are clustered by their count alone, and by their contexts; most do not travel with the tasks."""
    rng = np.random.default_rng(5)
    nouns, verbs = [f"n{i}" for i in range(300)], [f"v{i}" for i in range(300)]
    lines = [" ".join(w for _ in range(20) for w in ("the", nouns[rng.integers(300)], "will", verbs[rng.integers(300)])) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate([*lines, "seldom seldom seldom seldom"])), "doc_id long, text string")
    monkeypatch.setattr(brown, "SEEDS", 64)
    monkeypatch.setattr(brown, "KNOWN", 100)
    monkeypatch.setattr(brown, "CLASSES", 8)
    monkeypatch.setattr(brown, "TOTAL", 8 + brown.RARE + 1)
    model, table = brown.fit(frame, "text")
    got = {r.word: r for r in table.collect()}
    assert sum(r.c < 8 for r in got.values()) == sum(r.n >= brown.LEAST and w != brown.END for w, r in got.items()) == model.clustered > 500
    assert len(model.words) <= 100
    name = lambda w: int(next(brown.tokens(pa.array([w])))[1][0])
    assert got[name("seldom")].c >= 8
    n, v = (np.bincount([got[name(w)].c for w in x if got[name(w)].n >= brown.LEAST], minlength=8) for x in (nouns, verbs))
    assert np.maximum(n, v).sum() >= 0.9 * (n + v).sum() and n.argmax() != v.argmax()
    seen, size = np.zeros((brown.TOTAL, brown.TOTAL)), np.zeros(brown.TOTAL)
    coded = [[got[int(w)] for w in next(brown.tokens(pa.array([r.text])))[1]] for r in frame.orderBy("doc_id").collect()]
    for text in coded:
        np.add.at(seen, ([got[brown.END].c, *(r.c for r in text[:-1])], [r.c for r in text]), 1)
    size = seen.sum(axis=0)
    share, prior = (size + 1) / (size + 1).sum(), brown.PRIOR * brown.TOTAL
    assert np.allclose(model.moves, np.log10((seen + prior * share) / (seen.sum(axis=1, keepdims=True) + prior)))
    assert np.allclose(model.emit, np.log10(size + np.bincount([r.c for r in got.values()], minlength=brown.TOTAL) + 1))
    scored = rows(brown.score(frame, model, table, "doc_id", "text"))
    for i, text in enumerate(coded):
        c = [got[brown.END].c, *(r.c for r in text)]
        assert scored[i].n_known == len(text)
        assert scored[i].score == pytest.approx(sum(np.log10(r.n + 1) + model.moves[p, r.c] - model.emit[r.c] for p, r in zip(c, text, strict=False)))


def plain_pii(text):
    text = text or ""
    out = []
    digits = lambda m: [int(c) for c in m if c.isdigit()]
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])[::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_pii(spark, docs, texts):
    extra = {-1: "ip 1.2.3.4.5 and 256.1.1.1 a@b.c x@y 00000001.2.3.4", -2: "iban GB82 WEST 1234 5698 7654 32 card 4111 1111 1111 1111 +1 (310) 555-4510", -3: "call 310-555-4510 now é 4222222222222 visa", -4: None, -5: ""}
    frame = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    got = rows(pii.personal_data(frame))
    for i, t in (texts | extra).items():
        base = plain_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert set(base.split(",")) - {""} <= set(got[i].spans.split(","))
    assert "iban:5:" in got[-2].spans and "phone_local" in got[-3].spans and "card_short" in got[-3].spans
    assert got[-2].redacted.startswith("iban [IBAN]") and got[-4].redacted is None


def test_pii_patterns_equal_a_scan_from_every_position():
    rng = np.random.default_rng(3)
    for letters in ("a@.b1", "1.2", "12. -+()", "a@.-_%+1 ", "@.a"):
        for _ in range(4000):
            text = "".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(0, 40)))
            found = pii.find(text)
            assert pii.joined(found, pii.BASE) == plain_pii(text), text
            assert pii.emails(text) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def test_pii_on_long_and_odd_rows(spark, odd):
    began = time.time()
    for text in ("1" * 10**6, "a" * 10**6 + "@", "a" * 10**6 + "@b.c", "1." * 10**6, "@" * 10**6, "a@" * 10**6, "+1" + " " * 10**6, "A" * 10**6, "1-" * 10**6):
        pii.find(text)
    assert time.time() - began < 60
    got = pii.personal_data(odd).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in ODD) and all(r.redacted == dict((x[0], x[1]) for x in ODD)[r.doc_id] for r in got)
    assert pii.personal_data(odd.limit(0)).count() == 0
    clash = odd.select("doc_id", "text", F.lit(9).alias("n_ip"), F.lit("x").alias("spans"))
    assert "n_ip" in pii.personal_data(clash).columns and pii.personal_data(clash).agg(F.sum("n_ip")).first()[0] == 0


@pytest.mark.parametrize(
    ("text", "kind", "word"),
    [("My hotel ship zip {}", "phone_local", "My tel ship zip {}"), ("border {}", "ip", "order {}"), ("ship zip description {}", "ip", "ips and zip {}"), ("{} hotel", "phone", "{} (tel)")],
)
def test_pii_context_is_whole_words(text, kind, word):
    """Parts of other words move no score; the words themselves do, and one that the window cuts does not."""
    span = "10.0.0.1" if kind == "ip" else "415-555-2671"
    score = lambda t: pii.score_of(t.format(span), t.format(span).index(span), t.format(span).index(span) + len(span), kind)
    assert score(text) == pii.PRIOR[kind] != score(word)
    far = "x" * (pii.NEAR - 3)
    assert score(f"hotel{far}" + "{}") == pii.PRIOR[kind]


def test_pii_context_moves_scores():
    iban = "GB82WEST12345698765432"
    kinds = lambda t: {k: s[0][2] for k, s in pii.find(t).items() if s}
    assert kinds(f"see {iban}")["iban"] == pytest.approx(0.7) and kinds(f"bank account {iban}")["iban"] == 1
    assert "iban" not in kinds(f"invoice {iban}") and kinds(f"invoice, account {iban}")["iban"] == pytest.approx(0.7)
    assert "phone_local" not in kinds("see 310-555-4510") and "phone_local" in kinds("phone 310-555-4510")
    assert kinds("version 1.2.3.4")["ip"] == pytest.approx(0.3) and kinds("server 1.2.3.4")["ip"] == pytest.approx(0.9)


def test_packing(docs, texts, odd):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = odd.unionAll(odd.sparkSession.createDataFrame([(None, "No id " * 3000, None, None, "c", 2.0)] * 3, odd.schema)).withColumn("h", F.lit("x")).withColumn("copy", F.lit(7))
    everyone = {r[0]: r[1] for r in ODD} | {None: "No id " * 3000}
    for frame, known, times in ((docs, texts, {}), (odd, everyone, {"6": 2, "None": 3})):
        known = {str(i): t for i, t in known.items()}
        got = packing.pack(frame).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))).toPandas()
        for i, own in got.groupby("doc_id"):
            ids = np.array([*tok.encode(known[i] or "", add_special_tokens=False).ids, 1], "<u4")
            assert (own["doc_tokens"] == len(ids)).all() and (own["length"] > 0).all()
            for r in own.itertuples():
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            # Pieces of each copy join end to end, from 0 to the document's last id.
            copies = times.get(i, 1)
            starts, ends = collections.Counter(own["start"]), collections.Counter(own["start"] + own["length"])
            assert starts + collections.Counter({len(ids): copies}) == ends + collections.Counter({0: copies})
        assert set(got["doc_id"]) == set(known)
        fills = []
        for _, own in got.groupby("sequence_id"):
            own = own.sort_values("offset")
            assert (own["offset"].to_numpy() == np.concatenate(([0], own["length"].cumsum().to_numpy()[:-1]))).all()
            fills.append(int(own["length"].sum()))
        assert all(f <= 2048 and f & (f - 1) == 0 for f in fills)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_is_the_same_under_any_partitioning(docs):
    many = docs.select("doc_id", "text").unionAll(docs.select(F.lit(None).cast("long"), F.lit("the same words again").alias("text")).limit(300))
    runs = [sorted(packing.pack(frame).drop("ids").collect(), key=str) for frame in (many, many.repartition(7, F.rand(3)), many.orderBy(F.desc("text")).coalesce(1))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 300


def test_packing_cells_of_equal_rows(spark, monkeypatch):
    """A group of equal rows is cut into cells, and ranks stay gapless."""
    monkeypatch.setattr(packing, "CELL_ROWS", 5)
    frame = spark.createDataFrame([(i, 1, 3) for i in range(60)] + [(100 + i, 2 + i, 4) for i in range(20)], "row long, h long, n long")
    got = packing.numbered(frame, 80).collect()
    assert sorted(r["copy"] for r in got if r.h == 1) == list(range(60)) and all(r["copy"] == 0 for r in got if r.h > 1) and len(got) == 80


def test_nnls():
    rng = np.random.default_rng(4)
    a, x = rng.random((12, 30)), np.maximum(0, rng.standard_normal(30))
    b = a @ x
    z = packing.nnls(a, b)
    assert (z >= 0).all() and np.abs(a @ z - b).max() < 1e-6


def test_langid(docs, odd):
    got = rows(queries.op10_langid(docs.sparkSession, SF))
    known = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == known[i] for i in held]) > 0.9
    model = langid.fit(docs, "text", "lang", F.xxhash64("doc_id"))
    named = langid.identify(odd, model)
    assert named.columns == ["doc_id", "text", "lang", "source", "n", "lang_pred", "score"] and named.count() == len(ODD)
    bad = rows(named)
    assert {i: r.text for i, r in bad.items()} == {r[0]: r[1] for r in ODD}
    assert [bad[i].lang_pred for i in (1, 2, 3, 10)] == ["und"] * 4 and bad[9].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in bad.values())
    assert langid.fit(docs.limit(0), "text", "lang", F.lit(1)) is None


def plain_language(model, text):
    """Prediction of one text by sets of bits, n-gram by n-gram."""
    low = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    hits, total = [0] * len(model.langs), 0
    for n in langid.LENGTHS:
        for at in range(len(low) - n + 1):
            gram = low[at : at + n]
            if gram.strip(b" "):
                h = 0
                for b in gram:
                    h = (h * 257 + b) % 2**64
                h = int(langid.K.mix(np.array([(h + (n << 56)) % 2**64], np.uint64))[0])
                slots = [(h >> 20 * k) % langid.SLOTS for k in range(langid.HASHES)]
                total += 1
                for i in range(len(hits)):
                    hits[i] += all(int(model.slots[x, i // 64]) >> i % 64 & 1 for x in slots)
    rates = [min(max((h / max(total, 1) - f) / max(1 - f, 1e-9), 0), 1) for h, f in zip(hits, model.fill, strict=True)]
    scaled = [(r / max(o, 1e-9)) ** 4 + 1e-12 for r, o in zip(rates, model.own, strict=True)]
    best = max(range(len(scaled)), key=lambda i: scaled[i])
    return model.langs[best], scaled[best] / sum(scaled)


def test_langid_against_plain_counts(docs):
    model = langid.fit(docs, "text", "lang", F.xxhash64("doc_id"))
    for r in langid.identify(docs.where("length(text) < 600").limit(40), model).collect():
        if r.lang_pred != "und":
            name, score = plain_language(model, r.text)
            assert r.lang_pred == name and r.score == pytest.approx(score)


def test_more_than_64_languages(spark):
    """Each invented language has letters of its own; the 70 of them fill two words a slot."""
    letter = lambda i: chr(0x4E00 + 16 * i)
    rows = [(100 * i + k, f"{letter(i)}{chr(0x4E00 + 16 * i + 1)} " * 20, f"l{i:02d}") for i in range(70) for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame, "text", "lang", F.xxhash64("doc_id"))
    assert model.slots.shape[1] == 2
    assert all(r.lang_pred == r.lang for r in langid.identify(frame, model).collect())


def test_bounded_sample(spark):
    salt = F.xxhash64("id")
    rows = spark.range(5000)
    got = {r.id for r in common.bounded_sample(rows, salt, 400).collect()}
    assert 330 <= len(got) <= 400 and got == {r.id for r in common.bounded_sample(rows.repartition(3), salt, 400).collect()}
    hot = rows.unionAll(spark.range(4000).select(F.lit(7).cast("long").alias("id")))
    assert 300 <= common.bounded_sample(hot, salt, 400).count() <= 400
    assert common.bounded_sample(rows.select(F.lit(1).alias("id")), salt, 400).count() == 400
    assert common.bounded_sample(rows.limit(0), salt, 400).count() == 0


def test_bloom_has_no_false_negatives(docs):
    model = langid.fit(docs, "text", "lang", F.xxhash64("doc_id"))
    masks = model.masks(langid.grams(np.frombuffer(b"the and of ", np.uint8), np.array([0, 11]))[0])
    assert (masks[:, 0] >> np.uint64(model.langs.index("en")) & np.uint64(1)).any()


def test_toxicity(spark, odd):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    held = got[got["held_out"]].merge(labels, on="doc_id")
    a, b = held.loc[held["toxic"] == 1, "score"].to_numpy(), held.loc[held["toxic"] == 0, "score"].to_numpy()
    assert (a[:, None] > b[None]).mean() > 0.8
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    labels = odd.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    for learn in (labels, labels.limit(0)):
        net = toxicity.fit(odd, learn, F.xxhash64("id"))
        out = toxicity.score(odd, net)
        assert out.columns == ["doc_id", "text", "lang", "source", "n", "score", "predicted"] and out.count() == len(ODD)
        assert len({r.score for r in out.where("doc_id in (1, 2, 3)").collect()}) == 1 and all(0 <= r.score <= 1 for r in out.collect())
        assert toxicity.score(odd.limit(0), net).count() == 0


def test_toxicity_against_a_plain_network():
    """Scores of whole texts by the recurrence written out word by word, for a trained network."""
    rng = np.random.default_rng(1)
    clean = [" ".join(f"w{k}" for k in rng.integers(0, 60, rng.integers(1, 60))) for _ in range(60)]
    texts = clean + [c + " vile nasty slur" for c in clean[:20]]
    labels = np.array([0] * 60 + [1] * 20, float)
    net = toxicity.train(texts, labels)
    sig = lambda v: 1 / (1 + np.exp(-v))
    hashed = lambda t: toxicity.read(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))

    def vector(word):
        t = hashed(word)
        return np.concatenate((net.p["word"][net.ids(t.hashes)[0]], net.p["char"][t.grams].mean(axis=0)))

    def window(words):
        x, states = [vector(w) for w in words], np.zeros((len(words), 2 * toxicity.HIDDEN))
        for k, side, order in (("f", 0, range(len(x))), ("b", toxicity.HIDDEN, range(len(x) - 1, -1, -1))):
            h = np.zeros(toxicity.HIDDEN)
            for i in order:
                g, u = x[i] @ net.p[f"x{k}"] + net.p[f"b{k}"], h @ net.p[f"h{k}"]
                z, r, c = np.split(g, 3)[0] + np.split(u, 3)[0], np.split(g, 3)[1] + np.split(u, 3)[1], np.split(g, 3)[2]
                h = h + sig(z) * (np.tanh(c + sig(r) * np.split(u, 3)[2]) - h)
                states[i, side : side + toxicity.HIDDEN] = h
        e = np.exp(np.tanh(states @ net.p["att"]) @ net.p["query"])
        return (e / e.sum()) @ states @ net.p["out"] + net.p["bias"][0]

    n, step = toxicity.WINDOW, toxicity.STRIDE
    for text in texts[::7]:
        words = text.split()
        starts = [min(s, max(len(words) - n, 0)) for s in range(0, max(len(words) - n, 0) + step, step)] if len(words) > n else [0]
        best = max(window(words[s : s + n]) for s in starts)
        t = hashed(text)
        assert net.logits(t)[0].max() == pytest.approx(best, abs=1e-4)
    top = np.array([net.logits(hashed(t))[0].max() for t in texts])
    assert (sig(net.scale * np.clip(top, -20, 20) + net.shift) >= 0.5).tolist() == (labels == 1).tolist()


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.arange(5, dtype=np.uint64))
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, index = rng.standard_normal((7, toxicity.WORD_DIM + toxicity.CHAR_DIM)), rng.integers(0, 7, (6, toxicity.WINDOW))
    mask, y, w = np.ones(index.shape, bool), np.array([0, 1, 0, 1, 1, 0.0]), np.full(6, 1 / 6)
    mask[2, 5:] = False

    def loss():
        z = net.run(net.gates(x), index, mask)
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum())

    grads, _ = net.gradients(x, index, mask, y, w)
    for k in ("out", "query", "att", "hf", "xb", "bf"):
        flat = net.p[k].reshape(-1)
        i = len(flat) // 2
        old = flat[i]
        flat[i] = old + 1e-3
        up = loss()
        flat[i] = old - 1e-3
        down = loss()
        flat[i] = old
        assert grads[k].reshape(-1)[i] == pytest.approx((up - down) / 2e-3, abs=2e-6)


def test_url_filter(spark):
    pages = duckdb.connect()
    pages.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = pages.execute(queries.SQL["op9_url_filter"]).fetchdf().sort_values("page_id")
    got = queries.op9_url_filter(spark, SF).toPandas().sort_values("page_id")
    for c in want.columns:
        assert [None if pd.isna(x) else str(x)[:10] for x in got[c]] == [None if pd.isna(x) else str(x)[:10] for x in want[c]], c
    urls = ["http://a.b.c/x?q=1", None, "no url", "http://a.b.c/x?q=1", "", "http://user:pw@A.b.C./x", "HTTP://a.b.c:80/y", "http://net/z", "http://deep.net/z", "http://[::1]/", "http://xb.c/"]
    captures = spark.createDataFrame([(k, u, "2024-03-01", "clash") for k, u in enumerate(urls)] + [(20, "http://a.b.c/x", None, "clash")], "page_id long, url string, day string, n_active string")
    captures = captures.withColumn("fetch_day", F.to_date("day"))
    events = [("domain", " *.B.c. ", "2024-01-01", True), ("url", "http://A.b.c/x", "2024-02-01", True), ("url", "http://a.b.c/x", "2024-03-01", False), ("domain", None, "2024-01-01", True), ("domain", "net", "2024-03-01", True),
              ("domain", "net", "2024-03-01", False), ("domain", "", "2024-01-01", True), ("other", "b.c", "2024-01-01", True), ("domain", "b.c", "2024-03-02", False), ("domain", "a.b.c", "2024-01-01", True), ("domain", "a.b.c", "2024-01-05", False)]
    events = spark.createDataFrame(events, "kind string, value string, day string, added boolean")
    out = url_filters.evaluate(captures, events)
    assert out.columns == ["page_id", "url", "day", "fetch_day", "n_active", "listed_since", "blocked"]
    assert {r.page_id: r.n_active for r in out.collect()} == {0: 1, 1: 0, 2: 0, 3: 1, 4: 0, 5: 1, 6: 1, 7: 1, 8: 1, 9: 0, 10: 0, 20: 0}
    assert out.where("page_id = 7").first().listed_since.isoformat() == "2024-03-01"
    assert url_filters.evaluate(captures.unionAll(captures), events).count() == 24 and url_filters.evaluate(captures.limit(0), events).count() == 0
    assert url_filters.evaluate(captures, events.limit(0)).where("blocked").count() == 0


@pytest.mark.parametrize(
    ("kind", "value", "met", "missed"),
    [
        ("domain", "2.3", [], ["http://10.1.2.3/x", "http://2.3.4.5/", "http://b.2.3.net/"]), ("domain", "10.1.2.3", ["http://10.1.2.3/x", "http://u@10.1.2.3:81/"], ["http://1.10.1.2.3/"]),
        ("domain", "[::1.2.3.4]", ["http://[::1.2.3.4]/"], ["http://[::2.2.3.4]/"]), ("domain", "3.4]", [], ["http://[::1.2.3.4]/"]), ("domain", "0xff", ["http://0xFF/"], ["http://1.0xff/"]),
        ("url", "http://a.b.com/x", ["http://a.b.com:80/x", "http://me:pw@A.B.com/x?q", "HTTP://a.b.com.:/x#f"], ["http://a.b.com:8080/x", "https://a.b.com/x", "http://a.b.com:443/x"]),
        ("url", "https://u@a.com:443/x", ["https://a.com/x"], ["https://a.com:80/x"]), ("url", "http://a.com:81/", ["http://v@a.com:81/"], ["http://a.com/"]),
        ("url", "http://[::1]:80/x", ["http://[::1]/x"], ["http://[::1]:8/x"]),
    ],
)
def test_url_entries_of_addresses_and_ports(spark, kind, value, met, missed):
    captures = spark.createDataFrame([(u, "2024-03-01") for u in met + missed], "url string, fetch_day string")
    out = url_filters.evaluate(captures, spark.createDataFrame([(kind, value, "2024-01-01", True)], "kind string, value string, day string, added boolean"))
    assert {r.url for r in out.where("blocked").collect()} == set(met)


def test_as_of_equals_intervals(spark):
    """The last event decides: the same as a join of days with intervals."""
    rng = np.random.default_rng(7)
    day = lambda n: f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}"
    events = spark.createDataFrame([("domain", f"d{a}", day(int(b)), bool(c)) for a, b, c in zip(rng.integers(0, 6, 80), rng.integers(0, 90, 80), rng.integers(0, 2, 80), strict=True)], "kind string, value string, day string, added boolean")
    points = spark.createDataFrame([("domain", f"d{a}", day(b)) for a in range(7) for b in range(0, 95, 3)], "kind string, value string, day string").withColumn("day", F.to_date("day"))
    got = {tuple(r) for r in url_filters.as_of(points, events).collect()}
    want = points.alias("p").join(url_filters.intervals(events).alias("i"), ["kind", "value"]).where("day >= from_day and (to_day is null or day < to_day)").select("kind", "value", "day", "from_day")
    assert got == {tuple(r) for r in want.collect()} and got
