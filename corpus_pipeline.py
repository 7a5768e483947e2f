"""A training corpus in five stages: language, near duplicates, personal data, source mix, packing.

Every stage reads what its predecessor kept, whole, and its decisions take effect; all but the last return the columns of
``documents``.  None of the stages can be told in SQL as a whole, so ``ORACLE_SQL`` is None; tests hold each against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import langid, mixing, ngram_join, packing, pii
from stratafold.llm.common import fold, saved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without text go (``und``), so null and empty texts too; the others stay, whatever their label says,
    each row of a repeated id or text by itself.  Rows with a null id are judged, but teach nothing."""
    model = langid.fit(docs.where(fold("doc_id", 4) != 2), "text", "lang", F.xxhash64(F.lit(10), "doc_id"))
    # The operator's columns replace those of equal names, so the others travel beside the text in a struct.
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias("_")).alias("_row")
    kept = langid.identify(docs.select("text", rest), model).where("lang_pred <> 'und'")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, of the smallest id (null last), then row number.  Rows that share an id, or have
    none, are rows of their own: they go only if their text is a near duplicate.  Texts without words are near duplicates of nothing."""
    rows = saved(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_doc")), "rows")
    groups = ngram_join.jaccard_groups(rows.select("_row", F.col("_doc.text").alias("text")), "_row")
    order = F.struct(F.col("_doc.doc_id").isNull(), F.col("_doc.doc_id"), F.col("_row"))
    placed = rows.select("_row", order.alias("_order")).join(groups.select("_row", "component_id"), "_row")
    heads = placed.groupBy("component_id").agg(F.min("_order").alias("_head")).select(F.col("_head._row").alias("_row"))
    return rows.join(heads, "_row", "left_semi").select("_doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, and ``n_chars`` follows; every row stays, null texts as they are."""
    # The row travels as the operator's id, in a struct.
    found = pii.personal_data(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"), "_row", "text")
    length = lambda c: F.length("redacted").cast(docs.schema[c].dataType)
    return found.select(*[(F.col("redacted") if c == "text" else length(c) if c == "n_chars" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; those of which it takes nothing go, so those without words too.  A null source is a source, and
    rows of one id are documents of their own."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces with their token ids, by ``doc_id``, which may be null or repeat."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
