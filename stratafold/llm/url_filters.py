"""URL filters as a temporal list join, with DataFrame functions only.

Dated list events (an entry is added or removed on a day) become validity intervals: an entry is active from a day it is added
until its next event.  Captures are joined as of their fetch day: the last event of an entry up to that day decides.  An entry is a
``domain`` (matches the host and its subdomains; an IP address has none) or a ``url`` (matches the address without query and fragment).

Scale: what is looked up are distinct (kind, value, day), combined before the shuffle, so a host with a third of all captures is one row a day;
the window of an entry holds at most two rows a day, whatever the number of captures and events.  Entries that are active meet the addresses
by an equi-join on (kind, value, day), and results meet the captures by (URL, day); both tables are saved first, so Spark can split a
day of a hot host.  No interval is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

_HEAD = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dots; null where the text is no absolute URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def address_of(url: Column) -> Column:
    """The URL without query and fragment, scheme and host in lower case; null where nothing is left.

    The head is written as :func:`host_of` writes hosts: without user and final dots.  A port that is empty or the scheme's own (80 for
    http, 443 for https) is left out; another port names another server and stays."""
    address, head = F.regexp_extract(url, r"^[^?#]+", 0), F.regexp_extract(url, _HEAD, 0)
    plain = F.regexp_replace(F.lower(head), r"://.*@", "://")
    plain = F.regexp_replace(plain, r"^(http://.*):80$|^(https://.*):443$|^(.*):$", "$1$2$3")
    plain = F.regexp_replace(plain, r"([^./])\.+(:[0-9]+)?$", "$1$2")
    address = F.concat(plain, F.substr(address, F.length(head) + 1))
    return F.when(address != "", address)


def is_numeric(host: Column) -> Column:
    """Is the host an IP address?  In brackets, or its last label is a number, decimal or hexadecimal.  It has no parent domains."""
    return host.rlike(r"^\[|(^|\.)([0-9]+|0x[0-9a-f]*)$")


def domain_of(value: Column) -> Column:
    """A domain entry as hosts are written: lower case, without blanks, a leading ``*.`` or dot, and final dots; null where nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^\*?\.+|\.+$", "")
    return F.when(bare != "", bare)


def daily(events: DataFrame) -> DataFrame:
    """(kind, value, day, added) of ``events``, values normalised, one row for an entry and day.

    Of several events of an entry on a day, an addition wins.  Events with a null field, or of another kind, are left out."""
    value = F.when(F.col("kind") == "domain", domain_of(F.col("value"))).when(F.col("kind") == "url", address_of(F.trim("value")))
    rows = events.select("kind", value.alias("value"), F.col("day").cast("date").alias("day"), "added").dropna()
    return rows.groupBy("kind", "value", "day").agg(F.max("added").alias("added"))


def intervals(events: DataFrame) -> DataFrame:
    """(kind, value, from_day, to_day) of ``events`` (kind, value, day, added boolean); ``to_day`` is exclusive and null while nothing follows."""
    follow = F.lead("day").over(Window.partitionBy("kind", "value").orderBy("day"))
    return daily(events).withColumn("to_day", follow).where("added").select("kind", "value", F.col("day").alias("from_day"), "to_day")


def as_of(points: DataFrame, events: DataFrame) -> DataFrame:
    """Of the distinct ``points`` (kind, value, day) those at which the entry is active, with ``from_day``, the start of the interval."""
    event = F.struct("day", "added")
    both = daily(events).select("kind", "value", "day", event.alias("event"), F.lit(0).alias("asked"))
    both = both.unionByName(points.withColumns({"event": F.lit(None).cast("struct<day:date,added:boolean>"), "asked": F.lit(1)}))
    last = F.last("event", ignorenulls=True).over(Window.partitionBy("kind", "value").orderBy("day", "asked"))
    found = both.withColumn("last", last).where("asked = 1 and last.added")
    return found.select("kind", "value", "day", F.col("last.day").alias("from_day"))


def evaluate(captures: DataFrame, events: DataFrame, url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """``captures`` with ``n_active`` (entries that match and are active on the fetch day), ``listed_since`` (the latest addition of the
    one listed longest) and ``blocked``.

    Every row is kept, repeated ones too; the result depends on URL and day alone.  A null, empty or malformed URL or a null day matches
    nothing.  Columns of ``captures`` that are named like the three are replaced.  An empty table gives no rows."""
    added = ("n_active", "listed_since", "blocked")
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("day"))
    asked = rows.select("url", "day").where("url is not null and day is not null").distinct()
    host = host_of(F.col("url"))
    parts = F.when(is_numeric(host), F.array(host)).otherwise(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("value")))
    whole = F.array(F.struct(F.lit("url").alias("kind"), address_of(F.col("url")).alias("value")))
    keys = F.concat(F.when(parts.isNotNull(), suffixes).otherwise(F.slice(whole, 1, 0)), whole)
    asked = asked.withColumn("key", F.explode(keys)).select("url", "day", "key.kind", "key.value").where("value is not null")
    active = saved(as_of(asked.select("kind", "value", "day").distinct(), events), "active")
    found = asked.join(active, ["kind", "value", "day"]).groupBy("url", "day").agg(F.count("*").alias("n_active"), F.min("from_day").alias("listed_since"))
    out = rows.join(saved(found, "found"), ["url", "day"], "left")
    kept = [F.col(f"row.`{c}`") for c in captures.columns if c not in added]
    return out.select(*kept, F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "listed_since", F.col("n_active").isNotNull().alias("blocked"))
