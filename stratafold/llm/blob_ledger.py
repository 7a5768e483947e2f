"""Secret scans over a ledger of blobs, with DataFrame functions only.

Every version of every file is addressed by the SHA-256 of its text.  The ledger is an append-only table with a row for each blob and run: the
rules (name and version) that the run tried on it, and what they found.  A run scans each blob once, however many paths and versions hold it,
and of each blob only the rules whose present version the ledger lacks; findings are then joined back to all paths.

A match's position comes from the pieces around it: ``split`` gives the gaps between matches and ``regexp_extract_all`` the matches, both by
the same left-to-right search, so the running sum of their lengths is where a match ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved


@dataclass(frozen=True)
class Rule:
    """A pattern and its version; matches whose ``group`` is shorter than ``least`` characters are dropped and not tried again."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def tag(self) -> str:
        return f"{self.name}@{self.version}"


# The three base rules.  Of `access` and `hex` only long runs count, and a run's first match is its longest, so their bounds
# can stand in the pattern; a short value of `assign` may hold another keyword, so its bound is tested after the match.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Further kinds.  All are linear in the text: no run is scanned again from within.
MORE = (
    Rule("github", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("login", 1, r"://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/:@]{1,100}@"),
)
RULES = BASE + MORE

_SPAN = "struct<tag:string,start:bigint,end:bigint>"


def blob_of(text: str | Column) -> Column:
    """Content address of a text; a null text is the empty one."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """Rows (blob, tags, spans), one for each blob and run; None before the first run."""
    try:
        return spark.read.schema(f"blob string, tags array<string>, spans array<{_SPAN}>").parquet(ledger)
    except AnalysisException:
        return None


def _matches(rule: Rule, text: Column, wanted: Column) -> Column:
    """One struct for each gap of the text: its length, that of the match after it (null after the last), and whether the match counts."""
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x).cast("long"))
    gaps, hits = lengths(F.split(text, rule.pattern, -1)), lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    if rule.least:
        own = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    else:
        own = F.transform(hits, lambda x: x >= 0)
    hits = F.zip_with(hits, own, lambda h, ok: F.struct(h.alias("hit"), ok.alias("ok")))
    met = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h["hit"].alias("hit"), h["ok"].alias("ok")))
    rows = F.transform(met, lambda m, i: F.struct(F.lit(rule.tag).alias("tag"), i.alias("nth"), m["gap"].alias("gap"), m["hit"].alias("hit"), m["ok"].alias("ok")))
    return F.when(wanted & text.rlike(rule.pattern), rows).otherwise(F.array().cast(_ROWS))


_ROWS = "array<struct<tag:string,nth:int,gap:bigint,hit:bigint,ok:boolean>>"


def scan(history: DataFrame, ledger: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Append to ``ledger`` what the rules find in those blobs of ``history`` that they have not been tried on.

    Each blob is read once a run; a blob that every rule has seen is not scanned, and a rule of a new version is alone tried on old blobs.  A run
    that finds nothing new appends no rows.  Should rows of a failed run stay, they are repeated by the next one and count once.  Null texts are
    empty; an empty table leaves an empty ledger."""
    spark, tags = history.sparkSession, F.array(*[F.lit(r.tag) for r in rules])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # One row for each blob; copies are merged in each task before the shuffle.
    blobs = history.select(blob_of(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    known = read_ledger(spark, ledger)
    if known is None:
        todo = blobs.withColumn("tags", tags)
    else:
        tried = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tried"))
        left = F.array_except(tags, F.coalesce("tried", F.array().cast("array<string>")))
        todo = blobs.join(tried, "blob", "left").select("blob", "text", left.alias("tags")).where(F.size("tags") > 0)
    # A row without a match keeps the blobs in which nothing is found.
    none = F.array(F.struct(F.lit(None).cast("string").alias("tag"), F.lit(0).alias("nth"), F.lit(0).cast("long").alias("gap"), F.lit(None).cast("long").alias("hit"), F.lit(None).cast("boolean").alias("ok")))
    found = F.concat(none.cast(_ROWS), *[_matches(r, F.col("text"), F.array_contains("tags", r.tag)) for r in rules])
    rows = todo.select("blob", "tags", F.explode(found).alias("m")).select("blob", "tags", "m.*").where("tag is null or hit is not null")
    # Partitioned by blob since the first step, so neither the window nor the last grouping shuffles; texts are gone by now.
    end = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("blob", "tag").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    spans = rows.withColumn("end", end)
    span = F.struct("tag", (F.col("end") - F.col("hit")).alias("start"), "end")
    out = spans.groupBy("blob").agg(F.first("tags").alias("tags"), F.collect_list(F.when(F.col("ok"), span)).alias("spans"))
    out.write.mode("append").parquet(ledger)


def findings(history: DataFrame, ledger: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``history`` with ``blob`` and ``found``: its spans (start, kind as the place of the rule in ``rules``, end; code points, end
    exclusive) by start, then kind, of the rules' present versions.

    Rows whose blob the ledger lacks have no spans.  Repeated and null paths are rows of their own; ``history`` keeps all its columns but those
    named blob and found."""
    spark = history.sparkSession
    place = F.array(*[F.lit(r.tag) for r in rules])
    known = read_ledger(spark, ledger)
    spans = known.select("blob", F.explode("spans").alias("s")).where(F.array_contains(place, F.col("s.tag")))
    span = F.struct(F.col("s.start").alias("start"), (F.array_position(place, F.col("s.tag")) - 1).cast("int").alias("kind"), F.col("s.end").alias("end"))
    # Saved, so that Spark can split a blob of many paths in the join.
    found = saved(spans.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("found")), "found")
    row = F.struct(*[F.col(f"`{c}`") for c in history.columns], F.lit(0).alias("_")).alias("row")
    paths = history.select(row, blob_of(F.col(f"`{text_col}`").cast("string")).alias("blob"))
    rest = [F.col(f"row.`{c}`") for c in history.columns if c not in ("blob", "found")]
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return paths.join(found, "blob", "left").select(*rest, "blob", F.coalesce("found", empty).alias("found"))


def listed(found: Column, names: list[str]) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """In place of ``found``: a count ``n_<rule>`` for each base rule, the base spans' SHA-256 and all spans as text.  The base rules come first
    in ``rules``."""
    names = [r.name for r in rules]
    own = F.filter("found", lambda s: s["kind"] < len(base))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    made = {f"n_{r.name}": count(k) for k, r in enumerate(base)}
    return found.withColumns(made | {"base_sha256": F.sha2(listed(own, names), 256), "spans": listed(F.col("found"), names)}).drop("found")
