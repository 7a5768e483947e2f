"""Each stage on what its predecessor kept, against plain versions."""

import re

import brute

import corpus_pipeline
from stratafold.llm.common import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(saved(stage(spark, seen[-1], SF), f"test-{name}"))
        if name != "pack":
            assert seen[-1].columns == docs.columns, name
    rows = [{r.doc_id: r for r in df.collect()} for df in seen[:-1]]
    assert set(rows[1]) == {i for i, r in rows[0].items() if re.search(r"[^\W\d_]", r.text or "")}
    groups = brute.jaccard({i: r.text for i, r in rows[1].items()})
    assert set(rows[2]) == {i for i, (_, c) in groups.items() if i == c}
    assert set(rows[3]) == set(rows[2])
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text) for r in rows[3].values())
    assert all(rows[3][i].text == rows[2][i].text for i in rows[3] if "[" not in rows[3][i].text)
    words = lambda df: sum(len(r.text.split()) for r in df.values())
    assert set(rows[4]) <= set(rows[3]) and abs(words(rows[4]) - 1.5 * words(rows[3])) <= 0.02 * words(rows[3])
    packed = seen[5].toPandas()
    assert set(packed["doc_id"]) == set(rows[4])
    assert (packed.groupby("doc_id")["length"].sum() == packed.groupby("doc_id")["doc_tokens"].first()).all()


def test_rows_without_an_own_id(spark):
    """Null and shared ids: a row goes only if its text is a near duplicate."""
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven"), (None, "one two three four five six seven"), (5, "red green blue black white grey"),
            (5, "north south east west up down"), (7, "north south east west up down"), (3, "red green blue black white grey"), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(None, ""), (None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven"), (3, "red green blue black white grey"), (5, "north south east west up down"), (8, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty texts, repeated rows, columns with the operators' own names, and an empty table."""
    words = "north south east west up down left right"
    rows = [(1, f"{words} alpha", "en", "a"), (1, f"{words} alpha", "en", "a"), (None, None, None, None), (2, "", None, "b"), (3, "mail me at jo@example.org now, please and thank you", "en", None), (3, "one two three four five six", None, "a"),
            (None, "seven eight nine ten eleven twelve", "fr", "b"), (4, "12 34", "en", "a")]
    clash = {c: f"{c}!" for c in ("row", "_row", "size", "taken", "finish", "score", "lang_pred", "redacted", "rep", "root", "id", "target")}
    docs = spark.createDataFrame([(*r, *clash.values()) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in clash))
    want = {"language": 5, "near_duplicates": 4, "personal_data": 4}
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = saved(stage(spark, table, SF), f"odd-{name}")
            if name != "pack":
                assert out.columns == docs.columns, name
                assert all(r[c] == v for r in out.collect() for c, v in clash.items())
            n = out.count()
            if name in want and n:
                assert n == want[name], (name, n)
            table = out
