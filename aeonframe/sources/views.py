"""The engine's tables as views over the synthetic star schema, and the same views as DuckDB CTEs for the oracles.

All times are epoch milliseconds in longs; windows are half-open, an open end is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def tagged(kind: str, value: Column) -> Column:
    """A property value: its type tag and its canonical text."""
    return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ms", millis(F.col("ts")))
    start = F.col("ms") - F.col("ms") % DAY
    end = F.when(F.col("event_id") % 7 == 0, start + (F.col("event_id") % 5 + 1) * DAY)
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.floor(F.col("value") * 100).cast("string").alias("object"),
        start.alias("valid_from"), end.alias("valid_to"), F.col("ms").alias("tx_time"),
        F.concat(F.lit("agent"), (F.col("event_id") % 5).cast("string")).alias("actor"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("ms", millis(F.col("o_orderdate")))
    return o.select(
        (F.col("o_orderkey") + 1).alias("cursor"), F.lit("main").alias("scope"), F.col("ms").alias("at"),
        F.lit("order_state").alias("kind"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"),
        F.col("ms").alias("valid_from"), F.when(F.col("o_orderkey") % 11 == 0, F.col("ms") + 400 * DAY).alias("valid_to"),
        F.create_map(
            F.lit("status"), tagged("string", F.col("o_orderstatus")),
            F.lit("cents"), tagged("unsigned", F.round(F.col("o_totalprice") * 100).cast("long")),
            F.lit("priority"), tagged("string", F.col("o_orderpriority")),
        ).alias("properties"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min(millis(F.col("l_shipdate"))).alias("ms"), F.min("l_linenumber").alias("line"))
    return pair.select(
        (F.lit(1_000_000_000) + F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("cursor"), F.lit("main").alias("scope"), F.col("ms").alias("at"),
        F.lit("contains").alias("kind"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("id"),
        F.lit("order").alias("from_kind"), F.col("l_orderkey").cast("string").alias("from_id"),
        F.lit("part").alias("to_kind"), F.col("l_partkey").cast("string").alias("to_id"),
        F.col("ms").alias("valid_from"), F.when((F.col("l_orderkey") + F.col("l_partkey")) % 4 == 0, F.col("ms") + 30 * DAY).alias("valid_to"),
        F.create_map(F.lit("line"), tagged("unsigned", F.col("line").cast("long"))).alias("properties"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ms", millis(F.col("ts")))
    return e.select(
        (F.col("event_id") + 1).alias("cursor"), F.lit("main").alias("scope"), F.col("ms").alias("at"),
        F.concat(F.lit("agent"), (F.col("event_id") % 5).cast("string")).alias("actor"),
        F.col("event_type").alias("kind"), F.lit("user").alias("subject_kind"), F.col("user_id").cast("string").alias("subject_id"),
        F.create_map(
            F.lit("k"), tagged("unsigned", F.get_json_object("props", "$.k").cast("long")),
            F.lit("cents"), tagged("unsigned", F.floor(F.col("value") * 100)),
        ).alias("properties"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    start = (F.col("vec_id") % 10) * 1000
    return e.select(
        F.lit("main").alias("scope"), (F.col("vec_id") + 1).alias("source_cursor"), F.lit("embedding").alias("kind"),
        F.concat(F.lit("v"), (F.col("vec_id") % 400).cast("string")).alias("id"), F.lit("body").alias("field"),
        start.alias("valid_from"), F.when(F.col("vec_id") % 13 == 0, start + 5000).alias("valid_to"),
        F.col("embedding").alias("dense"),
        F.when(F.col("vec_id") % 5 != 0, F.create_map(F.lit("label"), tagged("unsigned", F.col("label").cast("long")))).otherwise(F.create_map().cast("map<string,struct<type:string,value:string>>")).alias("properties"),
    )


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("view", "purchase", "click", "signup", "error")))
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        millis(F.col("l_shipdate")).alias("at"), F.concat(F.lit("r"), (F.col("l_suppkey") % 7).cast("string")).alias("reader"),
        F.concat(F.lit("user:"), (F.col("l_partkey") % 150).cast("string")).alias("subject"),
        F.element_at(kinds, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("predicate"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return d.select(path.alias("path"), F.col("lang").alias("language"), F.size(F.split("text", "\n")).cast("long").alias("lines"), "text")


#: the same views in DuckDB SQL
CTE = {
    "claims": f"""claims AS (SELECT event_id AS seq, 'user:' || user_id AS subject, event_type AS predicate,
  CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS object, ms - ms % {DAY} AS valid_from,
  CASE WHEN event_id % 7 = 0 THEN ms - ms % {DAY} + (event_id % 5 + 1) * CAST({DAY} AS BIGINT) END AS valid_to,
  ms AS tx_time, 'agent' || (event_id % 5) AS actor FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events))""",
    "records": f"""recs AS (SELECT o_orderkey + 1 AS cursor, 'order_state' AS kind, 'c' || o_custkey AS id, ms AS valid_from,
  CASE WHEN o_orderkey % 11 = 0 THEN ms + {400 * DAY} END AS valid_to, o_orderstatus AS status,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority AS priority
  FROM (SELECT *, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000 AS ms FROM orders))""",
    "relations": f"""rels AS (SELECT 1000000000 + l_orderkey * 1000000 + l_partkey AS cursor, 'contains' AS kind,
  l_orderkey || ':' || l_partkey AS id, 'order' AS from_kind, CAST(l_orderkey AS VARCHAR) AS from_id, 'part' AS to_kind,
  CAST(l_partkey AS VARCHAR) AS to_id, ms AS valid_from, CASE WHEN (l_orderkey + l_partkey) % 4 = 0 THEN ms + {30 * DAY} END AS valid_to, line
  FROM (SELECT l_orderkey, l_partkey, min(epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000) AS ms, min(l_linenumber) AS line FROM lineitem GROUP BY ALL))""",
    "events": """evs AS (SELECT event_id + 1 AS cursor, epoch_us(ts) // 1000 AS at_ms, 'agent' || (event_id % 5) AS actor, event_type AS kind,
  CAST(user_id AS VARCHAR) AS subject_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 100) AS BIGINT) AS cents FROM events)""",
    "vectors": """vecs AS (SELECT vec_id + 1 AS source_cursor, 'v' || (vec_id % 400) AS id, (vec_id % 10) * 1000 AS valid_from,
  CASE WHEN vec_id % 13 = 0 THEN (vec_id % 10) * 1000 + 5000 END AS valid_to, CAST(embedding AS DOUBLE[]) AS dense,
  CASE WHEN vec_id % 5 <> 0 THEN label END AS label FROM embeddings)""",
    "access": """acc AS (SELECT epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000 AS at_ms, 'r' || (l_suppkey % 7) AS reader, 'user:' || (l_partkey % 150) AS subject,
  ['view', 'purchase', 'click', 'signup', 'error'][CAST(l_linenumber % 5 + 1 AS INTEGER)] AS predicate FROM lineitem)""",
    "files": """fil AS (SELECT 'src/' || source || '/' || doc_id || '.' || lang AS path, lang AS language, text, len(string_split(text, chr(10))) AS lines FROM documents)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)
