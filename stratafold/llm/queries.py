"""The registered queries of this subpackage: ``opN_<name>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh
from . import blob_ledger, brown, jpeg, langid, lattice, mixing, ngram_join, packing, pii, repair, spelling, toxicity, url_filters
from .common import documents, fold


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0), F.xxhash64(F.lit(2), "id"))
    held = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(held, model).drop("text")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media(documents(spark, sf_dir)).drop("media")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(documents(spark, sf_dir))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))  # a row of no id teaches and is not held out, as in op10
    scored = brown.fit_score(docs, ~out, "doc_id", "text")
    return scored.withColumns({"held_out": out, "perplexity": brown.perplexity(F.col("score"), F.col("n_tokens"))})


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir)).drop("redacted")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("ids")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on a day given by their id; list events come from every fifth, seventh and eleventh page.

    Every fourteenth page's ``url`` entry names a user and the scheme's own port, which a match looks past."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.withColumn("fetch_day", day(F.col("page_id") * 7919 % 365))
    host = url_filters.host_of(F.col("url"))
    parent = F.array_join(F.slice(F.split(host, r"\."), -3, 3), ".")
    spelt = F.regexp_replace(F.regexp_replace("url", "^http://([^/?#:@]+)([/?#]|$)", "http://reader@$1:80$2"), "^https://([^/?#:@]+)([/?#]|$)", "https://reader@$1:443$2")
    rows = F.array(
        F.when(F.col("page_id") % 5 == 0, F.struct(F.lit("domain").alias("kind"), host.alias("value"))),
        F.when(F.col("page_id") % 7 == 0, F.struct(F.lit("url").alias("kind"), F.when(F.col("page_id") % 14 == 0, spelt).otherwise(F.col("url")).alias("value"))),
        F.when((F.col("page_id") % 11 == 0) & (F.size(F.split(host, r"\.")) > 3), F.struct(F.lit("domain").alias("kind"), parent.alias("value"))),
    )
    start = F.col("page_id") * 31 % 365
    change = F.explode(F.array(F.struct(day(start).alias("day"), F.lit(True).alias("added")), F.struct(day(start + 20 + F.col("page_id") % 90).alias("day"), F.lit(False).alias("added"))))
    entries = pages.withColumn("entry", F.explode(rows)).where("entry is not null").withColumn("event", change)
    return url_filters.evaluate(captures, entries.select("entry.kind", "entry.value", "event.day", "event.added"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~out), "text", "lang", F.xxhash64(F.lit(10), "doc_id"))
    return langid.identify(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version of every document against a new ledger."""
    docs, ledger = documents(spark, sf_dir).select("doc_id", "text"), fresh(spark, "ledger")
    blob_ledger.scan(docs, ledger)
    return blob_ledger.digest(blob_ledger.findings(docs, ledger).drop("text"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


OPERATORS = (op1_embedding_neardup, op2_toxicity, op3_media, op4_ngram_join, op5_mix, op6_brown, op7_pii, op8_pack, op9_url_filter, op10_langid, op11_secrets, op12_conversations, op13_spelling)
QUERIES = {f.__name__: f for f in OPERATORS}

SQL = {
    "op9_url_filter": r"""
WITH captures AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 7919 % 365 AS INTEGER) AS fetch_day,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1)), '.'), '') AS host,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::([0-9]*))?', 2) AS port,
    regexp_replace(regexp_extract(url, '^[^?#]+', 0), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS path FROM pages),
parts AS (SELECT *, string_split(host, '.') AS labels, nullif(CASE WHEN scheme = '' THEN '' ELSE scheme || '://' || coalesce(host, '')
    || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END END || path, '') AS address,
    host[1] = '[' OR regexp_matches(labels[-1], '^([0-9]+|0x[0-9a-f]*)$') AS numeric FROM captures),
entries AS (
    SELECT page_id, 'domain' AS kind, host AS value FROM parts WHERE page_id % 5 = 0
    UNION ALL SELECT page_id, 'url', address FROM parts WHERE page_id % 7 = 0
    UNION ALL SELECT page_id, 'domain', array_to_string(labels[-3:], '.') FROM parts WHERE page_id % 11 = 0 AND len(labels) > 3),
events AS (
    SELECT kind, value, DATE '2024-01-01' + CAST(page_id * 31 % 365 AS INTEGER) AS day, true AS added FROM entries WHERE value IS NOT NULL
    UNION ALL SELECT kind, value, DATE '2024-01-01' + CAST(page_id * 31 % 365 + 20 + page_id % 90 AS INTEGER), false FROM entries WHERE value IS NOT NULL),
daily AS (SELECT kind, value, day, bool_or(added) AS added FROM events GROUP BY ALL),
spans AS (SELECT * FROM (SELECT kind, value, day AS from_day, lead(day) OVER (PARTITION BY kind, value ORDER BY day) AS to_day, added FROM daily) WHERE added),
met AS (SELECT c.page_id, count(*) AS n_active, min(s.from_day) AS listed_since FROM parts c JOIN spans s
    ON c.fetch_day >= s.from_day AND (s.to_day IS NULL OR c.fetch_day < s.to_day)
    AND CASE s.kind WHEN 'url' THEN c.address = s.value ELSE c.host = s.value OR (NOT c.numeric AND ends_with(c.host, '.' || s.value)) END GROUP BY 1)
SELECT c.page_id, c.url, c.fetch_day, coalesce(n_active, 0) AS n_active, listed_since, n_active IS NOT NULL AS blocked FROM parts c LEFT JOIN met USING (page_id)
""",
    "op11_secrets": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
rules(k, kind, re) AS (VALUES
    (1, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    (2, 'access', 'AKIA[A-Z0-9]+'), (3, 'hex', '[0-9a-f]+'), (4, 'github', 'gh[oprsu]_[A-Za-z0-9]{36,}'), (5, 'slack', 'xox[abprs]-[A-Za-z0-9-]{10,}'),
    (6, 'pem', '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), (7, 'login', '://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/:@]{1,100}@')),
cut AS (SELECT r, k, kind, unnest(string_split_regex(text, re)) AS gap, unnest(regexp_extract_all(text, re)) AS hit,
    unnest(CASE k WHEN 1 THEN regexp_extract_all(text, re, 2) ELSE regexp_extract_all(text, re) END) AS own,
    unnest(range(len(regexp_extract_all(text, re)) + 1)) AS nth FROM docs, rules WHERE regexp_matches(text, re)),
placed AS (SELECT r, k, kind, own, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY r, k ORDER BY nth) AS stop FROM cut WHERE hit IS NOT NULL),
spans AS (SELECT r, k, kind, (stop - length(hit))::BIGINT AS start, kind || ':' || (stop - length(hit))::BIGINT || ':' || stop::BIGINT AS span FROM placed
    WHERE CASE k WHEN 1 THEN length(own) >= 6 WHEN 2 THEN length(own) >= 20 WHEN 3 THEN length(own) >= 24 ELSE true END),
met AS (SELECT r, count(*) FILTER (k = 1) AS a, count(*) FILTER (k = 2) AS b, count(*) FILTER (k = 3) AS c,
    string_agg(span, ',' ORDER BY start, k) FILTER (k <= 3) AS base, string_agg(span, ',' ORDER BY start, k) AS every FROM spans GROUP BY r)
SELECT doc_id, sha256(text) AS blob, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN met USING (r)
""",
}
