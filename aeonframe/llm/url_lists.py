"""URL filters by a temporal list join.

A list is a log of dated entries: on a day a pattern is added to a category, or removed from it. The log becomes
validity intervals, one for each time an entry was in force, and captures are joined to the intervals as of the day
they were fetched: the pattern must match, and the day lie in the interval. A pattern is a host with all hosts below
it ("example.org"), or a URL prefix ("example.org/ads/"), so a capture's keys are the suffixes of its host and the
prefixes of host and path: those that end in a slash, and those as long as a pattern of that host which does not
("example.org/ads"). Decisions follow the most specific (longest) pattern in force; at equal length "allow" wins.

The main path is DataFrame functions only. The list is broadcast only if counted at most BROADCAST rows; beyond that
it is an ordinary join, where a host with a large share of the captures is split by Spark's skew handling.

Defined results: null or unparsable URLs have a null host, no keys and verdict "pass"; the host of a URL with an IPv6
address is that address in its brackets, whole; a null day matches nothing;
entries with a null day, pattern or category are ignored; an addition of what is in force, or a removal of what isn't,
changes nothing; of entries with the same day, pattern and category the addition counts; repeated captures are
repeated; an empty list passes everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import constants

BROADCAST = 200_000

#: the list of the registered query: day, action, pattern, category
ENTRIES = [
    ("2024-01-10", "add", "spam-farm.example.org", "spam"),
    ("2024-05-01", "remove", "spam-farm.example.org", "spam"),
    ("2024-08-15", "add", "spam-farm.example.org", "spam"),
    ("2024-01-01", "add", "cheap-pills.example.com", "pharma"),
    ("2024-03-20", "add", "cheap-pills.example.com", "spam"),
    ("2024-03-01", "add", "example.net", "trial"),
    ("2024-04-01", "remove", "example.net", "trial"),
    ("2024-02-01", "add", "example.net/es/", "region"),
    ("2024-10-01", "remove", "example.net/es/", "region"),
    ("2024-02-15", "add", "blog.ththan.example.net", "allow"),
    ("2024-07-01", "remove", "blog.ththan.example.net", "allow"),
    ("2024-06-01", "add", "example.org/de/", "region"),
    ("2024-06-01", "add", "tionsh.example.net", "malware"),
    ("2024-06-15", "remove", "tionsh.example.net", "malware"),
]


def entries(spark, rows=None) -> DataFrame:
    rows = ENTRIES if rows is None else rows
    made = constants(spark, list(rows) or [(None,) * 4], "day, action, pattern, category")
    return made.select(F.to_date(F.col("day").cast("string")).alias("day"), *[F.col(c).cast("string").alias(c) for c in ("action", "pattern", "category")])


def intervals(log: DataFrame) -> DataFrame:
    """pattern, category, from_day and to_day (exclusive; null: still in force)."""
    clean = log.where("day is not null and pattern is not null and category is not null and action in ('add', 'remove')")
    daily = clean.groupBy(F.lower("pattern").alias("pattern"), "category", "day").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    order = W.partitionBy("pattern", "category").orderBy("day")
    turns = daily.where("on is not null").withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(0))).where("on <> was")
    return turns.withColumn("to_day", F.lead("day").over(order)).where("on = 1").select("pattern", "category", F.col("day").alias("from_day"), "to_day")


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)(?:[:/?#]|$)", 1))
    return F.when(found != "", found)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:]+://[^/?#]*(/[^?#]*)", 1)


def keys(url: Column) -> Column:
    """The patterns that would match and are a host or end in a slash: host suffixes, and for each suffix the prefixes of
    the path that end in a slash."""
    labels = F.when(host(url).startswith("["), F.array(host(url))).otherwise(F.split(host(url), r"\."))  # an address has no parts
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path(url), "/")
    slashes = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(slashes, lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    long = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lower(p)))))
    return F.when(host(url).isNotNull(), F.array_distinct(F.concat(suffixes, long)))


def evaluate(captures: DataFrame, log: DataFrame) -> DataFrame:
    """captures (page_id, url, day): with host, n_active, categories (sorted, comma-joined), rule and verdict."""
    spans = intervals(log)
    if spans.limit(BROADCAST + 1).count() <= BROADCAST:
        spans = F.broadcast(spans)
    plain = captures.select("page_id", "url", "day")
    dated = plain.where("day is not null").select("page_id", "url", "day", keys(F.col("url")).alias("keys"))
    spread = dated.select("page_id", "url", "day", F.explode("keys").alias("pattern"))
    # patterns with a path that do not end in a slash: for each host in them, the lengths of their paths
    other = spans.where("contains(pattern, '/') and not endswith(pattern, '/')").select(F.substring_index("pattern", "/", 1).alias("key"), "pattern")
    sizes = other.groupBy("key").agg(F.collect_set(F.length("pattern") - F.length("key")).alias("sizes"))
    if other.limit(BROADCAST + 1).count() <= BROADCAST:
        sizes = F.broadcast(sizes)
    own = F.lower(path(F.col("url")))
    hosts = spread.where("not contains(pattern, '/')").withColumnRenamed("pattern", "key").join(sizes, "key")
    cut = hosts.select("page_id", "url", "day", "key", own.alias("own"), F.explode("sizes").alias("size")).where(F.col("size") <= F.length("own"))
    spread = spread.union(cut.select("page_id", "url", "day", F.concat("key", F.expr("substring(own, 1, size)")))).distinct()
    active = spread.join(spans, "pattern").where((F.col("from_day") <= F.col("day")) & (F.col("to_day").isNull() | (F.col("day") < F.col("to_day"))))
    rank = F.struct(F.length("pattern"), (F.col("category") == "allow").cast("int"), F.col("pattern"), F.col("category"))
    found = active.groupBy(F.col("page_id").alias("__page"), F.col("url").alias("__url"), F.col("day").alias("__day")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("c"), F.max_by(F.struct("pattern", "category"), rank).alias("top")
    )
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("url") == F.col("__url")) & (F.col("day") == F.col("__day"))
    verdict = F.when(F.col("top").isNull(), "pass").when(F.col("top.category") == "allow", "allow").otherwise("block")
    return plain.join(found, same, "left").select(
        "page_id", host(F.col("url")).alias("host"), F.col("day").alias("fetched_on"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("c", F.lit("")).alias("categories"), F.coalesce(F.col("top.pattern"), F.lit("")).alias("rule"), verdict.alias("verdict"),
    )


def fetched_on(page_id: Column) -> Column:
    """The registered table has no fetch time: its pages are taken to be fetched one after the other over 2024."""
    return F.date_add(F.lit("2024-01-01").cast("date"), (page_id % 366).cast("int"))


def sql() -> str:
    """The registered query in DuckDB SQL."""
    rows = ", ".join(f"(DATE '{d}', '{a}', '{p}', '{c}')" for d, a, p, c in ENTRIES)
    return f"""
WITH log(day, action, pattern, category) AS (VALUES {rows}),
daily AS (SELECT pattern, category, day, max(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS lit FROM log GROUP BY ALL),
turns AS (SELECT * FROM (SELECT *, coalesce(lag(lit) OVER (PARTITION BY pattern, category ORDER BY day), 0) AS was FROM daily) WHERE lit <> was),
spans AS (SELECT * FROM (SELECT pattern, category, day AS from_day, lit, lead(day) OVER (PARTITION BY pattern, category ORDER BY day) AS to_day FROM turns) WHERE lit = 1),
caps AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS day,
  nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[0-9A-Fa-f:.]+\\]|[^/?#:@\\[\\]]+)(?:[:/?#]|$)', 1)), '') AS host,
  lower(regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1)) AS path FROM pages),
hit AS (SELECT DISTINCT c.page_id, c.url, c.day, s.pattern, s.category FROM caps c JOIN spans s
  ON s.from_day <= c.day AND (s.to_day IS NULL OR c.day < s.to_day)
  AND (c.host = split_part(s.pattern, '/', 1) OR ends_with(c.host, '.' || split_part(s.pattern, '/', 1)))
  AND (NOT contains(s.pattern, '/') OR starts_with(c.path, substr(s.pattern, strpos(s.pattern, '/'))))),
best AS (SELECT page_id, url, day, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS c,
  max(ROW(length(pattern), CASE WHEN category = 'allow' THEN 1 ELSE 0 END, pattern, category)) AS top FROM hit GROUP BY ALL)
SELECT caps.page_id, caps.host, CAST(caps.day AS VARCHAR) AS fetched_on, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(c, '') AS categories,
  coalesce(top[3], '') AS rule, CASE WHEN top IS NULL THEN 'pass' WHEN top[4] = 'allow' THEN 'allow' ELSE 'block' END AS verdict
FROM caps LEFT JOIN best ON caps.page_id = best.page_id AND caps.url = best.url AND caps.day = best.day"""
