"""URL filters by a temporal list join.

A list is a log of dated entries: (list, action, key, added or removed, date). Entries of one key
become validity intervals, from each addition to the next removal. A capture asks for its host and
every parent domain of it. The as-of join puts intervals and fetch times of a (list, action, key) in order of time and
takes for each fetch time the last interval that began by then, which is the only one that can hold it, as the
intervals of a key don't overlap; it is active if it has not ended. The longest key wins; at equal length an
allow entry wins over a block entry, then the list that sorts last; no entry means allowed.

No (time, interval) pairs are formed. Times are cut into stretches of ``STRETCH`` days, and what
held when a stretch began is carried over into it, so a task sees one key's changes and fetch times of one stretch only,
and what a key's stretches carry over is one row each. Captures are first reduced to distinct (host, fetch time)
pairs on the map side, so a host that holds a third of all captures is asked for once per time, and the answers are
joined back on both. Neither side has a size bound, so nothing is broadcast by hint.

Defined results: a null or unparsable url has no host and is allowed, as is a null fetch time;
an IP address has no parent; repeated additions and removals change nothing; a removal on the day of an addition ends it
before it begins (intervals are half open, from <= time < to); entries with a null list, action, key or date are ignored;
rows that repeat get an answer each, as do rows that repeat or lack a page_id. All columns of the
captures are carried along, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.names import free
from weftgraph.storage import cut

#: Days of a stretch.
STRETCH = 32
_OWN = ["list", "action", "key"]


def host(url: Column) -> Column:
    """Lower-case host of an http(s) URL without port, user and trailing dot, or null. Brackets of an IPv6 address stay."""
    # The user part goes up to the last @ before the path.
    found = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#\\]*@)?(\[[^\]/?#\\]*\]|[^/?#\\:@\[\]]+)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def _keys(name: Column) -> Column:
    """A host and its parent domains; an address only itself."""
    parts = F.split(name, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(name.rlike(r"^(\[.*\]|\d+\.\d+\.\d+\.\d+)$"), F.array(name)).otherwise(every)


def _stretch(time: str) -> Column:
    return F.floor(F.unix_date(F.to_date(time)) / STRETCH).cast("int")


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, action, key, valid_from, valid_to)`` from ``(list, action, key, event, date)``; event is ``add`` or ``remove``."""
    # The last word of a day counts, and a removal is the last word.
    known = entries.where("list is not null and action is not null and key is not null and date is not null")
    days = known.groupBy(*_OWN, "date").agg(F.max(F.when(F.col("event") == "remove", 1).otherwise(0)).alias("ends")).withColumn("s", _stretch("date"))
    inside, across = Window.partitionBy(*_OWN, "s").orderBy("date"), Window.partitionBy(*_OWN).orderBy("s")
    # One row for each stretch says how the one before it ended.
    before = days.groupBy(*_OWN, "s").agg(F.max_by("ends", "date").alias("last")).select(*_OWN, "s", F.lag("last").over(across).alias("carried"))
    turns = days.join(before, [*_OWN, "s"]).withColumn("was", F.coalesce(F.lag("ends").over(inside), "carried")).where("was is null and ends = 0 or was <> ends")
    # Turns alternate, so an interval ends at the next turn: in this stretch, or the first of the next one that has any.
    after = turns.groupBy(*_OWN, "s").agg(F.min("date").alias("first")).select(*_OWN, "s", F.lead("first").over(across).alias("next"))
    spans = turns.withColumn("to", F.lead("date").over(inside)).join(after, [*_OWN, "s"]).where("ends = 0")
    return spans.select(*_OWN, F.col("date").alias("valid_from"), F.coalesce("to", "next").alias("valid_to"))


def as_of(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """``(list, action, key, at)`` for each of ``asked`` (``key``, ``at``) and each entry of its key that was active then."""
    kind = asked.schema["at"].dataType
    spans = cut(spans.select(*_OWN, F.col("valid_from").cast(kind).alias("at"), F.struct(F.col("valid_to").cast(kind).alias("to")).alias("span")), "intervals")
    asked = asked.join(spans.select(*_OWN).distinct(), "key").select(*_OWN, "at").withColumn("s", _stretch("at"))
    spans = spans.withColumn("s", _stretch("at"))
    # What holds when a stretch begins: the last interval of an earlier one.
    ends = spans.groupBy(*_OWN, "s").agg(F.max_by("span", "at").alias("last")).unionByName(asked.select(*_OWN, "s").distinct().withColumn("last", F.lit(None).cast(spans.schema["span"].dataType)))
    ends = ends.groupBy(*_OWN, "s").agg(F.max_by("last", F.col("last").isNotNull()).alias("last"))
    earlier = Window.partitionBy(*_OWN).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*_OWN, "s", F.lit(None).cast(kind).alias("at"), F.last("last", ignorenulls=True).over(earlier).alias("span")).where("span is not null")
    rows = carried.unionByName(spans).withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    by_then = Window.partitionBy(*_OWN, "s").orderBy(F.asc_nulls_first("at"), "asks")
    found = rows.withColumn("now", F.last("span", ignorenulls=True).over(by_then)).where("asks and now is not null")
    return found.where("now.to is null or at < now.to").select(*_OWN, "at")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (``url``, ``fetched`` and others) with ``blocked``, and the deciding ``list_name`` and ``list_key``."""
    pairs = captures.select(host(F.col("url")).alias("host"), F.col("fetched").alias("at")).where("host is not null and at is not null").distinct()
    asked = pairs.withColumn("key", F.explode(_keys(F.col("host"))))
    active = as_of(intervals(entries), asked.select("key", "at").distinct())
    # One winner for each key and time, then the longest key of each host.
    winners = active.groupBy("key", "at").agg(F.max(F.struct((F.col("action") == "allow").cast("int").alias("allow"), "list", "action")).alias("w"))
    rank = F.struct(F.length("key"), "key")
    best = asked.join(winners, ["key", "at"]).groupBy("host", "at").agg(F.max_by(F.struct("w.action", "w.list", "key"), rank).alias("best"))
    out = captures.drop("blocked", "list_name", "list_key")
    own, other, at, won = free(out.columns, "host", "asked_host", "at", "best")
    best = best.withColumnsRenamed({"host": other, "at": at, "best": won})
    out = out.withColumn(own, host(F.col("url"))).join(best, (F.col(own) == F.col(other)) & (F.col("fetched") == F.col(at)), "left")
    return out.withColumns({
        "blocked": F.coalesce(F.col(f"{won}.action") == "block", F.lit(False)), "list_name": F.col(f"{won}.list"), "list_key": F.col(f"{won}.key"),
    }).drop(own, other, at, won)


#: Dated entries for the synthetic pages, which come with no list: list, action, key, event, date.
ENTRIES = (
    ("spam", "block", "spam-farm.example.org", "add", "2020-03-01"),
    ("spam", "block", "spam-farm.example.org", "remove", "2021-06-01"),
    ("spam", "block", "spam-farm.example.org", "add", "2022-01-01"),
    ("spam", "block", "cheap-pills.example.com", "add", "2020-09-15"),
    ("spam", "block", "casino-bonus.example.net", "add", "2021-01-01"),
    ("review", "allow", "www.cheap-pills.example.com", "add", "2021-05-01"),
    ("review", "allow", "www.cheap-pills.example.com", "remove", "2021-11-01"),
    ("outage", "block", "example.net", "add", "2022-07-01"),
    ("outage", "block", "example.net", "remove", "2022-07-15"),
)


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: the table has no fetch time, so page k is fetched on day k mod 1461 from 2020-01-01."""
    return pages.select("page_id", "url", F.date_add(F.to_date(F.lit("2020-01-01")), F.pmod("page_id", F.lit(1461)).cast("int")).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """``ENTRIES``, and a watch list drawn from the pages themselves: each page whose id divides by 7 has its
    host blocked from the day it was fetched, and each whose id divides by 11 has it released."""
    spark = pages.sparkSession
    fixed = spark.createDataFrame(list(ENTRIES), "list string, action string, key string, event string, date string").withColumn("date", F.to_date("date"))
    captures = page_captures(pages).withColumn("key", host(F.col("url"))).where("key is not null")
    drawn = [
        captures.where(F.pmod("page_id", F.lit(n)) == 0).select(F.lit("watch").alias("list"), F.lit("block").alias("action"), "key", F.lit(event).alias("event"), F.col("fetched").alias("date"))
        for n, event in ((7, "add"), (11, "remove"))
    ]
    return fixed.unionByName(drawn[0]).unionByName(drawn[1])


#: The host by other means than in ``host``: what is between the scheme and the path, after the last @, up to the bracket or the port.
_HOST = """nullif(rtrim(CASE WHEN place LIKE '[%' THEN split_part(place, ']', 1) || ']' ELSE split_part(place, ':', 1) END, '.'), '')"""
_PLACE = r"""CASE WHEN lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%'
  THEN list_last(string_split(split_part(split_part(split_part(split_part(lower(url), '://', 2) || substr(lower(url), length(split_part(lower(url), '://', 1)) + length(split_part(lower(url), '://', 2)) + 4), '/', 1), '?', 1), '#', 1), '@')) END"""
SQL = f"""
WITH c AS (
  SELECT page_id, url, DATE '2020-01-01' + CAST(page_id % 1461 AS INTEGER) AS fetched, {_HOST} AS host FROM (SELECT page_id, url, {_PLACE} AS place FROM pages)
), e AS (
  SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in ENTRIES)}) v(list, action, key, event, date)
  UNION ALL SELECT 'watch', 'block', host, 'add', fetched FROM c WHERE page_id % 7 = 0 AND host IS NOT NULL
  UNION ALL SELECT 'watch', 'block', host, 'remove', fetched FROM c WHERE page_id % 11 = 0 AND host IS NOT NULL
), a AS (
  SELECT c.page_id, c.fetched, e.list, e.action, e.key, max(e.date) AS date FROM c JOIN e
  ON (c.host = e.key OR ends_with(c.host, '.' || e.key)) AND e.date <= c.fetched GROUP BY ALL
), last AS (
  SELECT a.page_id, a.list, a.action, a.key FROM a JOIN e ON e.list = a.list AND e.action = a.action AND e.key = a.key AND e.date = a.date
  GROUP BY ALL HAVING count(*) FILTER (WHERE e.event = 'remove') = 0
), best AS (
  SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, (action = 'allow') DESC, list DESC) = 1
)
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(b.action = 'block', false) AS blocked, b.list AS list_name, b.key AS list_key
FROM c LEFT JOIN best b USING (page_id)
"""
