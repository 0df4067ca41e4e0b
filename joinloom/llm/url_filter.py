"""URL filtering by a temporal join with dated lists.

A list's dated entries say from which day on a host (with all below it), a path
prefix, or one URL is blocked, allowed, or no longer listed.  The entries of a key
become validity intervals.  A capture has a key for its URL, for each prefix of its
path, and for each suffix of its host; the intervals that hold on the day it was
fetched are joined as of that day, and the most specific one decides.

An as-of join on a key alone compares a capture with all intervals of its key, and
both can be many.  Intervals are cut at the borders of fixed periods and joined on key
and period, in which a key has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a period of the join.
PERIOD = 8


def _host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.rtrim(host, F.lit("."))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def normalized(url: Column) -> Column:
    """Host in lower case, path and query; without scheme, user, port and fragment."""
    return F.concat(_host(url), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1))


def keys(url: Column, labels: int, folders: int) -> Column:
    """The keys of a URL from the least to the most specific: ``d:`` host suffixes of up
    to so many labels, ``p:`` path prefixes of up to so many folders, ``u:`` the URL.
    Null and URLs without a host have none."""
    host, path = _host(url), _path(url)
    names, parts = F.split(host, r"\."), F.split(path, "/")
    n, m = F.size(names), F.size(parts)
    none = F.array().cast("array<string>")

    def up_to(last: Column, key) -> Column:
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), key)).otherwise(none)

    domains = up_to(F.least(n, F.lit(labels)), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(names, n - k + 1, k), ".")))
    prefixes = up_to(F.least(m - 1, F.lit(folders)), lambda k: F.concat(F.lit("p:"), host, F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    return F.when(host != "", F.concat(domains, prefixes, F.array(F.concat(F.lit("u:"), normalized(url))))).otherwise(none)


def _longest(entries: DataFrame) -> tuple[int, int]:
    """Labels of the list's longest host suffix, and folders of its longest path prefix:
    a URL's keys beyond these are in no entry, and all of a very long URL's would take
    the square of its length."""
    key = F.col("key")
    labels = F.max(F.when(key.startswith("d:"), F.size(F.split(key, r"\."))))
    folders = F.max(F.when(key.startswith("p:"), F.size(F.split(key, "/")) - 1))
    return tuple(x or 0 for x in entries.agg(labels, folders).first())


def intervals(entries: DataFrame) -> DataFrame:
    """entries (entry_id, key, action, dated) -> key, action, since, until (exclusive;
    null: still holds).  On one day the entry with the greatest entry_id holds, so a
    key has a row a day at most, however many entries it has."""
    daily = entries.filter("key IS NOT NULL AND dated IS NOT NULL").groupBy("key", F.col("dated").cast("date").alias("since"))
    daily = daily.agg(F.max(F.struct(F.col("entry_id"), F.col("action"))).alias("e"))
    following = Window.partitionBy("key").orderBy("since")
    return daily.select("key", F.col("e.action").alias("action"), "since", F.lead("since").over(following).alias("until")).filter("action IN ('block', 'allow')")


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched, any others) with blocked and matched_key.

    entries: entry_id, key, action (``block``, ``allow``, or ``remove``; others and null
    end the key's listing), dated.  blocked: whether the most specific key with an entry
    active on the day of ``fetched`` is blocked; matched_key is that key, null if none
    is active.  A null url or fetched matches nothing.  Repeated rows and ties give equal
    results; every row is returned.  blocked and matched_key replace columns of those names.  Without
    entries nothing is blocked; without captures there are no rows.  A url has keys
    for as many of its folders and labels as the list's longest key has, however long it is.
    """
    captures = captures.drop("blocked", "matched_key")
    day = F.col("fetched").cast("date")
    pair = captures.select("url", day.alias("day")).filter("url IS NOT NULL AND day IS NOT NULL").distinct()
    first, last = pair.agg(F.min("day"), F.max("day")).first()
    probe = pair.select("url", "day", F.posexplode(keys(F.col("url"), *_longest(entries))).alias("rank", "key"))
    probe = probe.withColumn("period", F.floor(F.unix_date("day") / PERIOD))
    held = intervals(entries).filter((F.col("since") <= F.lit(last)) & (F.col("until").isNull() | (F.col("until") > F.lit(first))))
    start, stop = F.greatest("since", F.lit(first)), F.least(F.coalesce(F.date_sub("until", 1), F.lit(last)), F.lit(last))
    held = held.withColumn("period", F.explode(F.sequence(F.floor(F.unix_date(start) / PERIOD), F.floor(F.unix_date(stop) / PERIOD))))
    found = probe.join(held, ["key", "period"]).filter((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    best = found.groupBy("url", "day").agg(F.max(F.struct("rank", "key", "action")).alias("e"))
    best = best.select(F.col("url").alias("u"), F.col("day").alias("d"), F.col("e.key").alias("matched_key"), (F.col("e.action") == "block").alias("blocked"))
    out = captures.join(best, (F.col("url") == F.col("u")) & (day == F.col("d")), "left").drop("u", "d")
    return out.withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def captures_of(pages: DataFrame) -> DataFrame:
    """The query's captures: pages have no date, so one follows from page_id."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(page_id * 7 % 360 AS int))").alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """The query's list: hosts and folders of some pages are listed and unlisted again."""
    host = _host(F.col("url"))
    folder = F.concat(F.lit("p:"), host, F.regexp_replace(_path(F.col("url")), "[^/]*$", ""))
    site = F.concat(F.lit("d:"), F.regexp_replace(host, r"^[^.]*\.", ""))
    rest = F.col("page_id") % 10
    key = F.when(rest.isin(0, 5, 7), F.concat(F.lit("d:"), host)).when(rest == 3, folder).when(F.col("page_id") % 100 == 1, site)
    action = F.when(rest == 5, "remove").when(rest == 7, "allow").otherwise("block")
    dated = F.expr("date_add(DATE'2024-01-01', CAST(page_id * 13 % 360 AS int))")
    return pages.select(F.col("page_id").alias("entry_id"), key.alias("key"), action.alias("action"), dated.alias("dated")).filter("key IS NOT NULL")


#: For the query: its rows from the table ``pages``.
SQL = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 7 % 360 AS INTEGER) AS fetched, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
e AS (SELECT page_id AS entry_id, DATE '2024-01-01' + CAST(page_id * 13 % 360 AS INTEGER) AS dated,
  CASE WHEN page_id % 10 IN (0, 5, 7) THEN 'd:' || host WHEN page_id % 10 = 3 THEN 'p:' || host || regexp_replace(path, '[^/]*$', '') WHEN page_id % 100 = 1 THEN 'd:' || regexp_replace(host, '^[^.]*\.', '') END AS key,
  CASE page_id % 10 WHEN 5 THEN 'remove' WHEN 7 THEN 'allow' ELSE 'block' END AS action FROM c),
k AS (SELECT page_id, fetched, key, rank FROM (
  SELECT page_id, fetched, 'd:' || array_to_string(string_split(host, '.')[-n:], '.') AS key, n AS rank FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS n FROM c)
  UNION ALL SELECT page_id, fetched, 'p:' || host || array_to_string(string_split(path, '/')[1:n], '/') || '/', 1000 + n FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS n FROM c))),
last AS (SELECT k.page_id, k.key, any_value(k.rank) AS rank, max({'d': e.dated, 'i': e.entry_id, 'a': e.action}) AS x FROM k JOIN e ON e.key = k.key AND e.dated <= k.fetched GROUP BY 1, 2),
best AS (SELECT page_id, max({'r': rank, 'k': key, 'a': x.a}) AS b FROM last WHERE x.a <> 'remove' GROUP BY 1)
SELECT c.page_id, coalesce(b.a = 'block', false) AS blocked, b.k AS matched_key FROM c LEFT JOIN best USING (page_id)
"""
