"""Temporal list join: captures judged by the list entries that were active when they were fetched.

List events (list, pattern, day, action add or remove) become validity intervals: an entry holds from its day to the next
event of the same list and pattern. A pattern is a host, a domain (any suffix of the host from a label on), or a host
with the first segment of the path. A capture looks up all patterns that it matches; of each it is given the entry that
was active at its fetch time (an as-of join). Intervals are filed by the months they touch, so a pattern with a long
history, or one that a third of all captures match, compares a capture with the entries of one month; Spark splits
skewed keys of that join.

The longest active pattern decides, the list of the smallest name among equals. An `allow` list lets a capture pass, any
other blocks it. A null or unreadable url matches nothing and passes. Of several events of a list, pattern and day the
removal counts. Captures are judged by url and fetch time alone, whatever their keys; repeated ones each; null fetch
times match nothing. Entries are filed under the months that captures have, of any year. Empty tables give all captures
unmatched, or none. Extra columns of captures stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Days in a bucket of the interval index.
BUCKET = 30


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def first_segment(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1), F.lit(""))


def patterns(url: Column) -> Column:
    """The host with its path's first segment, the host, and its suffixes of two labels or more."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    with_path = F.when(first_segment(url).isNotNull(), F.array(F.concat_ws("/", host(url), first_segment(url)))).otherwise(F.array().cast("array<string>"))
    return F.when(host(url).isNotNull(), F.array_distinct(F.concat(with_path, suffixes))).otherwise(F.array().cast("array<string>"))


def intervals(events: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (exclusive; null: open) of the entries that the events (list, pattern, day, action) add."""
    daily = events.filter("list IS NOT NULL AND pattern IS NOT NULL AND day IS NOT NULL").groupBy("list", "pattern", "day").agg(F.max("action").alias("action"))
    after = Window.partitionBy("list", "pattern").orderBy("day")
    return daily.withColumn("valid_to", F.lead("day").over(after)).filter("action = 'add'").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def _bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BUCKET)


def judge(captures: DataFrame, events: DataFrame, *, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:  # noqa: ARG001
    """captures with n_active (entries in force), list, pattern (those that decide; null if none) and blocked. key isn't read."""
    captures = captures.drop(*[c for c in captures.columns if c in ("n_active", "list", "pattern", "blocked")])
    asked = captures.select(F.col(url).alias("_url"), F.col(fetched).alias("_at")).filter("_url IS NOT NULL AND _at IS NOT NULL").distinct()
    asked = asked.withColumns({"_day": F.to_date("_at"), "_pattern": F.explode(patterns(F.col("_url")))}).withColumn("_bucket", _bucket(F.col("_day")))
    # Entries are filed under the buckets that captures ask for, whatever their year: one row, as many as the calendar has.
    used = captures.agg(F.collect_set(_bucket(F.to_date(fetched))).alias("_used"))
    until = F.date_sub("valid_to", 1)
    touched = F.filter("_used", lambda b: (b >= _bucket(F.col("valid_from"))) & (until.isNull() | (b <= _bucket(until))))
    filed = intervals(events).crossJoin(F.broadcast(used)).withColumn("_bucket", F.explode(touched)).drop("_used")
    active = asked.join(filed, (asked["_pattern"] == filed["pattern"]) & (asked["_bucket"] == filed["_bucket"]) & (F.col("_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to"))))
    best = F.min(F.struct((-F.length("pattern")).alias("n"), "list", "pattern"))
    found = active.groupBy("_url", "_at").agg(F.count(F.lit(1)).alias("n_active"), best.alias("_best"))
    # Names that captures don't have.
    at, when, best = (common.spare_name(captures, c) for c in ("_url", "_at", "_best"))
    found = found.withColumnsRenamed({"_url": at, "_at": when, "_best": best})
    joined = captures.join(found, (F.col(url) == F.col(at)) & (F.col(fetched) == F.col(when)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in captures.columns], F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col(best)["list"].alias("list"), F.col(best)["pattern"].alias("pattern"), F.coalesce(F.col(best)["list"] != "allow", F.lit(False)).alias("blocked"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time; the tables have none, so it follows from the id: a minute of 2024."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(527040)).cast("int")
    return pages.select("page_id", "url", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minute)).alias("fetched"))


def events_of(pages: DataFrame) -> DataFrame:
    """List events about the hosts, domains and paths that the pages have; days and lists follow from their digests."""
    found = pages.select(F.explode(patterns(F.col("url"))).alias("pattern")).distinct()
    digit = lambda at, n: F.conv(F.substring(F.md5("pattern"), at, n), 16, 10).cast("int")
    named = found.filter(digit(1, 2) < 128).withColumns({
        "list": F.when(digit(3, 1) < 4, "allow").when(digit(3, 1) < 10, "spam").otherwise("adult"),
        "a": digit(4, 3) % 366, "b": digit(7, 3) % 200 + 1, "c": digit(10, 3) % 100 + 1,
    })
    day = lambda *cols: F.date_add(F.to_date(F.lit("2024-01-01")), sum((F.col(c) for c in cols), F.lit(0)))
    event = lambda action, *cols: F.struct(day(*cols).alias("day"), F.lit(action).alias("action"))
    return named.select("list", "pattern", F.inline(F.array(event("add", "a"), event("remove", "a", "b"), event("add", "a", "b", "c"))))


def op8_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(captures_of(pages), events_of(pages)).select("page_id", "fetched", F.col("n_active").cast("long").alias("n_active"), "list", "pattern", "blocked")


OP8_SQL = r"""
WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((page_id * 7919) % 527040 AS INTEGER)) AS fetched,
  nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS h,
  nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1), '') AS s FROM pages),
l AS (SELECT *, string_split(h, '.') AS x FROM p WHERE h IS NOT NULL),
k AS (SELECT DISTINCT page_id, fetched, unnest(list_concat(CASE WHEN s IS NULL THEN [] ELSE [h || '/' || s] END,
  list_transform(generate_series(1, greatest(len(x) - 1, 1)), lambda i: array_to_string(x[i:], '.')))) AS pattern FROM l),
d AS (SELECT pattern, md5(pattern) AS m FROM (SELECT DISTINCT pattern FROM k)),
n AS (SELECT pattern, CASE WHEN ('0x' || m[3:3])::INT < 4 THEN 'allow' WHEN ('0x' || m[3:3])::INT < 10 THEN 'spam' ELSE 'adult' END AS list,
  ('0x' || m[4:6])::INT % 366 AS a, ('0x' || m[7:9])::INT % 200 + 1 AS b, ('0x' || m[10:12])::INT % 100 + 1 AS c
  FROM d WHERE ('0x' || m[1:2])::INT < 128),
i AS (SELECT list, pattern, DATE '2024-01-01' + a AS f, DATE '2024-01-01' + (a + b) AS t FROM n
  UNION ALL SELECT list, pattern, DATE '2024-01-01' + (a + b + c), NULL FROM n),
j AS (SELECT k.page_id, i.list, i.pattern, count(*) OVER (PARTITION BY k.page_id) AS n_active,
  row_number() OVER (PARTITION BY k.page_id ORDER BY length(i.pattern) DESC, i.list, i.pattern) AS r
  FROM k JOIN i ON k.pattern = i.pattern AND CAST(k.fetched AS DATE) >= i.f AND (i.t IS NULL OR CAST(k.fetched AS DATE) < i.t))
SELECT p.page_id, p.fetched, coalesce(j.n_active, 0) AS n_active, j.list, j.pattern, coalesce(j.list <> 'allow', FALSE) AS blocked
FROM p LEFT JOIN j ON p.page_id = j.page_id AND j.r = 1
"""
