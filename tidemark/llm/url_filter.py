"""URL filters as a temporal join of captures with a dated list.

A list is a history of entries (pattern, action, day it was listed).  The entries of a pattern
become validity intervals: each holds from its day until the next entry of the pattern.  A capture
is judged by the entries that were active when it was fetched: its host, every parent domain of two
or more labels, and its host with as many path segments as the longest listed pattern has are looked
up as of its day, and the most specific active entry decides (path before host before parent).
Without one, it is kept.

Only DataFrame functions are used.  The intervals are written once.  They are joined on (pattern,
period): an interval stands in every period of ``PERIOD`` days it touches, a capture in one, and a pair
is looked at only if it is in the same period.  If the intervals are few (counted first) they are
broadcast and nothing is shuffled by host at all; else they stand in ``SALT`` copies, so that a host
with a third of all captures is spread over the periods and the copies.

Null or unparsable URLs and null days match nothing and are kept; very long URLs are cut into no more
prefixes than the list has segments; repeated captures are judged each; entries with a null pattern or
day are ignored, and without any all captures are kept; of several entries of a pattern on a day the
smallest action name counts; an empty table of captures gives an empty result; clashing column names
do no harm, other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import written

PERIOD = 32
SMALL, SALT = 50_000, 8
PATH = 1 << 20  # the rank of a path with one segment, above that of any host
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"[^/?#]*(/[^?#]*)", 1)


def patterns(url: Column, segments: int) -> Column:
    """Array of (pattern, rank) that could decide about ``url``, with up to so many path segments; a
    higher rank is more specific."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda k: F.struct(F.array_join(F.slice(labels, k, n), ".").alias("pattern"), (n - k + 1).alias("rank")),
    )
    parts = F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, segments)
    prefixes = F.transform(
        parts, lambda p, k: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k + 1), "/")).alias("pattern"), (PATH * (k + 1)).alias("rank"))
    )
    return F.when(host != "", F.concat(parents, prefixes)).otherwise(F.expr("array()").cast("array<struct<pattern:string,rank:int>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) with ``until`` null for the last entry of a pattern."""
    daily = entries.where("pattern is not null and listed is not null").groupBy("pattern", "listed").agg(F.min("action").alias("action"))
    w = Window.partitionBy("pattern").orderBy("listed")
    return daily.select("pattern", "action", F.col("listed").cast("int").alias("since"), F.lead("listed").over(w).cast("int").alias("until"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, fetched, kept, action, pattern, since) of every capture (page_id, url, fetched)."""
    caps = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched").cast("int").alias("fetched"))
    same = caps.groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    last = caps.agg(F.coalesce(F.max("fetched"), F.lit(0))).first()[0]
    held = intervals(entries).where(F.col("since") <= last)
    upto = F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last))
    held = written(held.withColumn("period", F.explode(F.sequence(F.floor(F.col("since") / PERIOD).cast("int"), F.floor(upto / PERIOD).cast("int")))))
    n, deepest = held.agg(F.count(F.lit(1)), F.max(F.size(F.split("pattern", "/")) - 1)).first()
    asked = same.select("*", F.explode_outer(patterns(F.col("url"), deepest or 0)).alias("p"), F.floor(F.col("fetched") / PERIOD).cast("int").alias("period"))
    asked = asked.select("page_id", "url", "fetched", "copies", "period", "p.pattern", "p.rank")
    if n <= SMALL:
        held, asked = F.broadcast(held.withColumn("salt", F.lit(0))), asked.withColumn("salt", F.lit(0))
    else:
        held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    found = asked.join(held, ["pattern", "period", "salt"], "left")
    active = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("until") > F.col("fetched")))
    hit = F.when(active, F.struct(F.col("rank"), F.col("action"), F.col("pattern"), F.col("since")))
    best = found.groupBy("page_id", "url", "fetched", "copies").agg(F.max(hit).alias("hit"))
    out = best.select(
        "page_id", "fetched", "copies",
        (F.coalesce(F.col("hit.action"), F.lit("allow")) != "block").alias("kept"),
        F.col("hit.action").alias("action"), F.col("hit.pattern").alias("pattern"), F.col("hit.since").alias("since"),
    )
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "__copy")
