"""The registered queries, each with its twin in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, context, feed, filters, graph, integrity, routing, temporal, vector
from ..sources import views
from ..sources.views import DAY, table, with_
from . import ql

#: instants used below: 2024-01-16 for claims and events, 1998-06-30 for orders
T, T_ORDER = 1_705_363_200_000, 899_164_800_000
HEAD = (1 << 62) - 1
#: a fixed query vector of 64 dimensions
QUERY = [round(((k * 37) % 19 - 9) / 10, 1) for k in range(64)]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


# -- the query language -------------------------------------------------------------------------------------
def tables(spark: SparkSession, d: str) -> ql.Catalog:
    order = {"status": ("string", True), "cents": ("unsigned", True), "priority": ("string", True)}
    event = {"k": ("unsigned", False), "cents": ("unsigned", True)}
    kinds = ("view", "purchase", "click", "signup", "error")
    return ql.Catalog(
        HEAD, views.records(spark, d), views.relations(spark, d), views.events(spark, d), views.claims(spark, d),
        {("record", "order_state"): order, ("relation", "contains"): {"line": ("unsigned", True)}, **{("event", k): event for k in kinds}},
    )


_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY cursor DESC) AS rn FROM {log}
  WHERE cursor <= {c} AND valid_from <= {t}) WHERE rn = 1 AND (valid_to IS NULL OR {t} < valid_to)"""
_AS_OF = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC) AS rn2 FROM
  (SELECT *, row_number() OVER (PARTITION BY subject, predicate, valid_from ORDER BY tx_time DESC, seq DESC) AS rn FROM {src} WHERE valid_from <= {t})
  WHERE rn = 1 AND (valid_to IS NULL OR {t} < valid_to)) WHERE rn2 = 1"""


@_register(f"""{with_("records")}, snap AS ({_LATEST.format(log="recs", c=12000, t=T_ORDER)})
SELECT 'record:order_state:' || id AS identity, id, cents, valid_from FROM snap WHERE status = 'F' ORDER BY identity LIMIT 500""")
def ql_record_scan(spark, d):
    text = 'FROM record:order_state AT VALID $t KNOWN 12000 WHERE status = "F" PROJECT id, cents, valid_from LIMIT 500'
    return ql.run(text, tables(spark, d), {"t": T_ORDER})


@_register(f"""{with_("relations")}, snap AS ({_LATEST.format(log="rels", c=HEAD, t=T_ORDER)})
SELECT 'relation:contains:' || id AS identity, from_id, to_id, CAST(line AS BIGINT) AS line FROM snap WHERE line = 3 ORDER BY identity LIMIT 2000""")
def ql_relation_scan(spark, d):
    return ql.run("FROM relation:contains AT VALID $t KNOWN HEAD WHERE line = 3 PROJECT from_id, to_id, line LIMIT 2000", tables(spark, d), {"t": T_ORDER})


@_register(f"""{with_("events")} SELECT 'event:purchase:' || cursor AS identity, cursor, subject_id, cents FROM evs
WHERE kind = 'purchase' AND at_ms <= {T} AND actor = 'agent2' ORDER BY identity LIMIT 1000""")
def ql_event_scan(spark, d):
    return ql.run('FROM event:purchase AT VALID $t KNOWN HEAD WHERE actor = "agent2" PROJECT cursor, subject_id, cents LIMIT 1000', tables(spark, d), {"t": T})


@_register(f"""{with_("claims")}, now AS ({_AS_OF.format(src="(SELECT * FROM claims WHERE seq <= 8000 AND predicate = 'click')", t=T)})
SELECT 'claim:' || subject || ':' || predicate AS identity, object, valid_from, tx_time FROM now ORDER BY identity""")
def ql_claim_scan(spark, d):
    return ql.run("FROM claim:click AT VALID $t KNOWN 8000 PROJECT object, valid_from, tx_time", tables(spark, d), {"t": T})


@_register(f"""{with_("records")}, snap AS ({_LATEST.format(log="recs", c=HEAD, t=T_ORDER)}) SELECT 'record:order_state:' || id AS identity, valid_to FROM snap WHERE valid_to IS NULL ORDER BY identity""")
def ql_null_equality(spark, d):
    return ql.run("FROM record:order_state AT VALID $t KNOWN HEAD WHERE valid_to = null PROJECT valid_to", tables(spark, d), {"t": T_ORDER})


@_register()
def ql_explain_contract(spark, d):
    return ql.run("FROM record:order_state AT VALID 5 KNOWN 9 PROJECT * EXPLAIN CONTRACT", tables(spark, d))


@_register(f"""{with_("records")}, snap AS ({_LATEST.format(log="recs", c=HEAD, t=T_ORDER)}), top AS (SELECT 'record:order_state:' || id AS identity, id FROM snap ORDER BY identity LIMIT 700),
sized AS (SELECT *, sum(strlen(identity) + strlen(id) + 23) OVER (ORDER BY identity ROWS UNBOUNDED PRECEDING) AS b, row_number() OVER (ORDER BY identity) AS rn FROM top)
SELECT identity, CAST((rn - 1) // 256 AS INTEGER) AS batch, b <= 20000 AS kept FROM sized""")
def ql_budget_batches(spark, d):
    rows = ql.run("FROM record:order_state AT VALID $t KNOWN HEAD PROJECT id LIMIT 700", tables(spark, d), {"t": T_ORDER})
    return ql.budgeted(rows, 20_000).select("identity", "batch", "kept")


# -- bitemporal ---------------------------------------------------------------------------------------------
@_register(f"""{with_("claims")}, now AS ({_AS_OF.format(src="claims", t=T)}) SELECT subject, predicate, object, valid_from, valid_to, tx_time, seq FROM now""")
def claim_as_of(spark, d):
    return temporal.as_of(views.claims(spark, d), T).select("subject", "predicate", "object", "valid_from", "valid_to", "tx_time", "seq")


@_register(f"""{with_("claims")} SELECT seq, predicate, object, valid_from FROM claims WHERE subject = 'user:7'""")
def claim_history(spark, d):
    return temporal.history(views.claims(spark, d), "user:7").select("seq", "predicate", "object", "valid_from")


@_register(f"""{with_("claims")} SELECT seq, subject, predicate, tx_time FROM claims WHERE tx_time > {T}""")
def claim_changed_since(spark, d):
    return temporal.changed_since(views.claims(spark, d), T).select("seq", "subject", "predicate", "tx_time")


@_register(f"""{with_("claims")} SELECT seq, subject, object FROM claims WHERE seq > 1000 AND seq <= 2500""")
def claim_sequence_range(spark, d):
    return temporal.sequence_range(views.claims(spark, d), 1000, 2500).select("seq", "subject", "object")


@_register(f"""{with_("claims")} SELECT DISTINCT subject FROM claims""")
def claim_subjects(spark, d):
    return temporal.subjects(views.claims(spark, d))


_CURRENT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, tx_time DESC, seq DESC) AS rn FROM {src}) WHERE rn = 1"""


@_register(f"""{with_("claims")} SELECT subject, predicate, object, valid_from, valid_to, seq FROM ({_CURRENT.format(src="claims")})""")
def claim_current_projection(spark, d):
    return temporal.current_projection(views.claims(spark, d)).select("subject", "predicate", "object", "valid_from", "valid_to", "seq")


@_register(f"""{with_("claims")}, cur AS ({_CURRENT.format(src="claims")}),
suc AS (SELECT subject, predicate, 'next' AS object, {T + 40 * DAY} AS t FROM cur WHERE predicate = 'click')
SELECT c.subject, c.predicate, 'retire' AS step, c.object, c.valid_from, s.t AS valid_to, s.t AS tx_time FROM cur c JOIN suc s USING (subject, predicate)
UNION ALL SELECT subject, predicate, 'assert', object, t, NULL, t FROM suc""")
def claim_supersede_pairs(spark, d):
    now = temporal.current_projection(views.claims(spark, d))
    nexts = now.where("predicate = 'click'").select("subject", "predicate", F.lit("next").alias("object"), F.lit(T + 40 * DAY).alias("at"))
    return temporal.supersede_pairs(now, nexts)


@_register(f"""{with_("claims")} SELECT seq, sha256(subject || '|' || predicate || '|' || object || '|' || valid_from || '|' || coalesce(CAST(valid_to AS VARCHAR), 'open')) AS digest FROM claims WHERE seq > 100 AND seq <= 900""")
def differential_range(spark, d):
    return temporal.differential(views.claims(spark, d), 100, 900).select("seq", "digest")


@_register(f"""{with_("claims")} SELECT subject, predicate, object, valid_from, seq FROM ({_CURRENT.format(src="claims")})""")
def rebuild_incremental(spark, d):
    claims = views.claims(spark, d)
    half = temporal.current_projection(claims.where("seq <= 5000"))
    return temporal.fold(half, claims, 5000).select("subject", "predicate", "object", "valid_from", "seq")


@_register(f"""{with_("claims")}, a AS ({_CURRENT.format(src="(SELECT * FROM claims WHERE seq <= 5000)")}), b AS ({_CURRENT.format(src="claims")})
SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.predicate, b.predicate) AS predicate,
CASE WHEN a.subject IS NULL THEN 'missing' WHEN b.subject IS NULL THEN 'extra' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.subject = b.subject AND a.predicate = b.predicate
WHERE a.subject IS NULL OR b.subject IS NULL OR a.object <> b.object OR a.valid_from <> b.valid_from OR a.valid_to IS DISTINCT FROM b.valid_to OR a.tx_time <> b.tx_time""")
def grounding_diff(spark, d):
    claims = views.claims(spark, d)
    return temporal.grounding(temporal.current_projection(claims.where("seq <= 5000")), temporal.current_projection(claims))


@_register(f"""{with_("claims")} SELECT seq, CAST(ceil((strlen(subject) + strlen(predicate) + strlen(object) + strlen(actor)) / 4.0) AS BIGINT) AS tokens FROM claims""")
def token_cost(spark, d):
    return views.claims(spark, d).select("seq", temporal.token_cost("subject", "predicate", "object", "actor").alias("tokens"))


def _wanted(spark, d):
    return views.claims(spark, d).select("subject").distinct().select((F.crc32(F.col("subject").cast("binary")) % 10).alias("query"), F.crc32(F.col("subject").cast("binary")).alias("place"), "subject")


@_register()
def recall_budget(spark, d):
    return temporal.recall(views.claims(spark, d), _wanted(spark, d), T, 120)


_FILL = """WITH RECURSIVE costs AS (SELECT user_id % 20 AS g, event_id, CAST(1 + event_id % 17 AS BIGINT) AS cost, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS rn FROM events),
fill AS (SELECT g, rn, event_id, cost, cost AS spent, true AS taken FROM costs WHERE rn = 1
UNION ALL SELECT c.g, c.rn, c.event_id, c.cost, f.spent + CASE WHEN f.spent + c.cost <= 100 THEN c.cost ELSE 0 END, f.spent + c.cost <= 100 FROM fill f JOIN costs c ON c.g = f.g AND c.rn = f.rn + 1)
SELECT g, event_id, cost, max(spent) OVER (PARTITION BY g) AS spent FROM fill QUALIFY taken"""


@_register(_FILL)
def budget_fill(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 20).alias("g"), "event_id", (F.col("event_id") % 17 + 1).alias("cost"))
    return temporal.budget_fill(rows, ["g"], ["event_id"], "cost", 100).select("g", "event_id", "cost", "spent")


@_register(f"""{with_("claims")}, prompts AS (SELECT conv_id * 1000 + turn AS prompt, 'Look at USER' || (conv_id % 30) || ' and ' || role || '; \u00e9t\u00e9' || (turn % 3) AS text FROM conversations),
words AS (SELECT DISTINCT prompt, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_-]+')) AS w FROM prompts),
known AS (SELECT DISTINCT 'User' || substr(subject, 6) AS subject FROM claims UNION SELECT '\u00c9T\u00c91')
SELECT DISTINCT prompt, subject FROM words JOIN known ON lower(subject) = w""")
def subject_match(spark, d):
    c = table(spark, d, "conversations")
    text = F.concat(F.lit("Look at USER"), (F.col("conv_id") % 30).cast("string"), F.lit(" and "), "role", F.lit("; \u00e9t\u00e9"), (F.col("turn") % 3).cast("string"))
    known = views.claims(spark, d).select(F.concat(F.lit("User"), F.substring("subject", 6, 100)).alias("subject")).union(spark.sql("select '\u00c9T\u00c91'"))
    return temporal.subject_match(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt"), text.alias("text")), known)


_NOW = T + 30 * DAY


@_register(f"""{with_("claims")}, live AS ({_AS_OF.format(src="claims", t=_NOW)}),
e AS (SELECT subject, predicate, max(valid_to) AS until FROM claims GROUP BY ALL)
SELECT e.subject, e.predicate, CASE WHEN l.subject IS NOT NULL THEN 'current' WHEN until <= {_NOW} THEN 'expired' ELSE 'never' END AS state,
CASE WHEN l.subject IS NULL AND until <= {_NOW} THEN CAST(floor(({_NOW} - until) / {DAY}.0) AS BIGINT) END AS days
FROM e LEFT JOIN live l ON e.subject = l.subject AND e.predicate = l.predicate""")
def verification_ttl(spark, d):
    return temporal.verification_state(views.claims(spark, d), _NOW)


@_register(f"""{with_("claims", "access")}, c AS (SELECT subject, predicate, count(*) AS versions FROM claims GROUP BY ALL),
a AS (SELECT subject, predicate, count(*) AS n, max(at_ms) AS m, arg_max(reader, (at_ms, reader)) AS r FROM acc WHERE at_ms BETWEEN {T_ORDER} AND {T_ORDER + 300 * DAY} GROUP BY ALL)
SELECT c.subject, c.predicate, versions, coalesce(n, 0) AS accesses, m AS last_at, r AS last_reader, n IS NULL AS candidate FROM c LEFT JOIN a ON c.subject = a.subject AND c.predicate = a.predicate""")
def removal_report(spark, d):
    return temporal.removal_report(views.claims(spark, d), views.access(spark, d), T_ORDER, T_ORDER + 300 * DAY)


@_register("""SELECT user_id, arg_max(v, event_id) AS value FROM (SELECT user_id, event_id, CASE WHEN event_id % 9 = 0 THEN 'gone' ELSE event_type END AS v FROM events WHERE event_id <= 6000)
GROUP BY user_id HAVING arg_max(v, event_id) <> 'gone'""")
def kv_snapshot_read(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("value"))
    return temporal.version_at(rows, ["user_id"], 6000)


# -- graph --------------------------------------------------------------------------------------------------
@_register(f"""{with_("records", "events")}, snap AS ({_LATEST.format(log="recs", c=HEAD, t=T)})
SELECT kind, id, valid_from FROM snap UNION ALL SELECT kind, 'cursor:' || cursor, at_ms FROM evs WHERE at_ms <= {T}""")
def graph_snapshot_nodes(spark, d):
    return graph.snapshot_nodes(views.records(spark, d), T, HEAD, views.events(spark, d)).select("kind", "id", "valid_from")


@_register(f"""{with_("relations", "events")}, snap AS ({_LATEST.format(log="rels", c=HEAD, t=T)})
SELECT kind, id, from_kind, from_id, to_kind, to_id FROM snap UNION ALL SELECT 'emitted', 'cursor:' || cursor, 'user', subject_id, kind, 'cursor:' || cursor FROM evs WHERE at_ms <= {T}""")
def graph_snapshot_edges(spark, d):
    return graph.snapshot_edges(views.relations(spark, d), T, HEAD, views.events(spark, d)).select("kind", "id", "from_kind", "from_id", "to_kind", "to_id")


@_register(f"""{with_("records")}, a AS ({_LATEST.format(log="recs", c=HEAD, t=T_ORDER)}), b AS ({_LATEST.format(log="recs", c=HEAD, t=T_ORDER + 200 * DAY)})
SELECT 'order_state' AS kind, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.id = b.id WHERE a.cursor IS DISTINCT FROM b.cursor AND (a.id IS NULL OR b.id IS NULL OR a.valid_from <> b.valid_from OR a.status <> b.status OR a.cents <> b.cents OR a.priority <> b.priority OR a.valid_to IS DISTINCT FROM b.valid_to)""")
def graph_diff(spark, d):
    log = views.records(spark, d)
    return graph.diff(graph.latest(log, T_ORDER, HEAD), graph.latest(log, T_ORDER + 200 * DAY, HEAD), ["valid_from", "valid_to", "properties"])


@_register(f"""{with_("relations")}, snap AS ({_LATEST.format(log="rels", c=HEAD, t=T)}) SELECT id, 'out' AS side, to_id AS other FROM snap WHERE from_id = '77' UNION ALL SELECT id, 'in', from_id FROM snap WHERE to_id = '77'""")
def graph_neighbors(spark, d):
    edges = graph.snapshot_edges(views.relations(spark, d), T, HEAD)
    out = graph.outgoing(edges, "order", "77").select("id", F.lit("out").alias("side"), F.col("to_id").alias("other"))
    return out.union(graph.incoming(edges, "part", "77").select("id", F.lit("in").alias("side"), F.col("from_id").alias("other")))


_GRAPH = """edges AS (SELECT DISTINCT 'customer' AS fk, 'c' || c_custkey AS fi, 'nation' AS tk, 'n' || c_nationkey AS ti FROM customer UNION ALL SELECT 'supplier', 's' || s_suppkey, 'nation', 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'nation', 'n' || n_nationkey, 'region', 'r' || n_regionkey FROM nation)"""


def _places(spark, d):
    def edge(df, fk, fi, tk, ti):
        return df.select(F.lit(fk + "_" + tk).alias("kind"), F.lit(fk).alias("from_kind"), F.concat(F.lit(fk[0]), F.col(fi).cast("string")).alias("from_id"), F.lit(tk).alias("to_kind"), F.concat(F.lit(tk[0]), F.col(ti).cast("string")).alias("to_id"))

    c, s, n = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    return edge(c, "customer", "c_custkey", "nation", "c_nationkey").union(edge(s, "supplier", "s_suppkey", "nation", "s_nationkey")).union(edge(n, "nation", "n_nationkey", "region", "n_regionkey"))


@_register(f"""WITH RECURSIVE {_GRAPH}, both_ways AS (SELECT * FROM edges UNION ALL SELECT tk, ti, fk, fi FROM edges),
walk AS (SELECT 'supplier' AS kind, 's3' AS id, 0 AS depth UNION SELECT b.tk, b.ti, w.depth + 1 FROM walk w JOIN both_ways b ON b.fk = w.kind AND b.fi = w.id WHERE w.depth < 3)
SELECT kind, id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY kind, id""")
def graph_bfs(spark, d):
    return graph.bfs(_places(spark, d), ("supplier", "s3"), 3, both_ways=True)


@_register(f"""WITH RECURSIVE {_GRAPH}, walk AS (SELECT 'customer' AS kind, 'c5' AS id, 0 AS depth UNION SELECT b.tk, b.ti, w.depth + 1 FROM walk w JOIN edges b ON b.fk = w.kind AND b.fi = w.id WHERE w.depth < 2 AND b.fk = 'customer')
SELECT kind, id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY kind, id""")
def graph_bfs_kinds(spark, d):
    return graph.bfs(_places(spark, d), ("customer", "c5"), 2, ("customer_nation",))


@_register()
def graph_pagerank(spark, d):
    e = _places(spark, d).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(1.0).alias("weight"))
    nodes = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    return graph.pagerank(e, nodes, 30).select("id", F.round("rank", 9).alias("rank"))


@_register(f"""{with_("records")}, staged AS (SELECT cursor, kind, id, valid_from, valid_to FROM recs UNION ALL SELECT 1000000000 + row_number() OVER (ORDER BY id), 'order_state', id, {T_ORDER}, NULL FROM (SELECT DISTINCT 'c' || o_custkey AS id FROM orders WHERE o_custkey % 50 = 0)),
snap AS ({_LATEST.format(log="staged", c=HEAD, t=T_ORDER)}) SELECT kind, id, valid_from, valid_to FROM snap""")
def transaction_preview(spark, d):
    base = views.records(spark, d)
    new = table(spark, d, "orders").where("o_custkey % 50 = 0").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")).distinct()
    none = F.create_map().cast("map<string,struct<type:string,value:string>>")
    pending = new.select(F.lit(0).alias("ordinal"), F.lit("main").alias("scope"), F.lit(T_ORDER).alias("at"), F.lit("order_state").alias("kind"), "id", F.lit(T_ORDER).alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), none.alias("properties"))
    return graph.preview(base, pending, T_ORDER).select("kind", "id", "valid_from", "valid_to")


# -- constraints --------------------------------------------------------------------------------------------
@_register("""SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def dangling_refs(spark, d):
    refs = table(spark, d, "lineitem").select(F.lit("part").alias("kind"), F.col("l_partkey").cast("string").alias("id")).distinct()
    known = table(spark, d, "part").where("p_size > 5").select(F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("id"))
    return constraints.dangling(refs, known).select("id")


@_register(f"""{with_("relations")}, w AS (SELECT *, coalesce(valid_to, {HEAD * 2 + 1}) AS e FROM rels)
SELECT DISTINCT b.id, b.to_id FROM w a JOIN w b ON a.to_id = b.to_id AND a.id <> b.id AND a.valid_from < b.e AND b.valid_from < a.e AND (a.valid_from, a.id) < (b.valid_from, b.id)""")
def unique_overlap(spark, d):
    rows = views.relations(spark, d)
    return constraints.unique_overlaps(rows.select("id", "to_id", "valid_from", "valid_to"), ["to_id"], ["id"]).select("id", "to_id")


_SWEEP = """steps AS (SELECT to_id, valid_from AS t, 1 AS d FROM rels UNION ALL SELECT to_id, valid_to, -1 FROM rels WHERE valid_to IS NOT NULL),
run AS (SELECT to_id, sum(d) OVER (PARTITION BY to_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM steps)"""


@_register(f"""{with_("relations")}, {_SWEEP} SELECT to_id, CAST(greatest(max(o), 0) AS BIGINT) AS most FROM run GROUP BY to_id""")
def max_overlap(spark, d):
    return constraints.max_overlap(views.relations(spark, d), ["to_id"])


@_register(f"""{with_("relations")}, {_SWEEP} SELECT to_id, CAST(max(o) AS BIGINT) AS most FROM run GROUP BY to_id HAVING max(o) > 25""")
def cardinality_violations(spark, d):
    return constraints.cardinality_violations(views.relations(spark, d), ["to_id"], 25)


@_register("""SELECT event_id, (SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderkey <= e.event_id) AS asof_key FROM events e""")
def as_of_lookup(spark, d):
    left = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), F.col("event_id").alias("at"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("key"))
    return constraints.as_of_join(left, right, ["k"], "at", ["key"]).select("event_id", "asof_key")


@_register("""SELECT scope, revision FROM (SELECT 's' || (o_custkey % 40) AS scope, o_orderkey AS revision, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderkey <= 700) WHERE rn = 1""")
def schema_at_cursor(spark, d):
    reg = table(spark, d, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 40).cast("string")).alias("scope"), F.col("o_orderkey").alias("cursor"), F.col("o_orderkey").alias("revision"))
    return constraints.schema_at(reg, 700).select("scope", "revision")


@_register("""WITH o AS (SELECT sha256(text) AS sha256, any_value(strlen(text)) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1)
SELECT sha256, CASE WHEN doc_id % 5 = 0 THEN 'corrupt' WHEN doc_id % 2 = 0 THEN 'reachable' ELSE 'orphan' END AS state FROM o""")
def object_reachability(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("length"))
    objects = docs.groupBy("sha256").agg(F.first("length").alias("length"), F.min("doc_id").alias("doc_id"))
    present = objects.select("sha256", F.col("sha256").alias("found_sha256"), F.when(F.col("doc_id") % 5 == 0, F.col("length") + 1).otherwise(F.col("length")).alias("found_length"))
    return constraints.reachability(objects, objects.where("doc_id % 2 = 0"), present)


# -- vectors ------------------------------------------------------------------------------------------------
_Q = "[" + ", ".join(f"{x}" for x in QUERY) + "]::DOUBLE[]"
_SEEN = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_cursor DESC) AS rn FROM vecs WHERE valid_from <= 7000) WHERE rn = 1 AND (valid_to IS NULL OR 7000 < valid_to)"""


def _vec_sql(score: str, where: str = "true") -> str:
    return f"""{with_("vectors")}, seen AS ({_SEEN}) SELECT id, source_cursor, round({score}, 6) AS score FROM seen WHERE {where} ORDER BY {score} DESC, id LIMIT 20"""


def _vec(spark, d, metric, where=None):
    found = vector.search(views.vectors(spark, d), QUERY, 20, metric, scope="main", cursor=HEAD, t=7000, field="body", where=where)
    return found.select("id", "source_cursor", F.round("score", 6).alias("score"))


@_register(_vec_sql(f"list_cosine_similarity(dense, {_Q})"))
def vec_cosine_topk(spark, d):
    return _vec(spark, d, "cosine")


@_register(_vec_sql(f"list_inner_product(dense, {_Q})"))
def vec_dot_topk(spark, d):
    return _vec(spark, d, "dot")


@_register(_vec_sql(f"-list_distance(dense, {_Q})"))
def vec_l2_topk(spark, d):
    return _vec(spark, d, "l2")


@_register(_vec_sql(f"-list_sum(list_transform(list_zip(dense, {_Q}), lambda x: abs(x[1] - x[2])))"))
def vec_l1_topk(spark, d):
    return _vec(spark, d, "l1")


@_register(_vec_sql(f"list_cosine_similarity(dense, {_Q})", "label IS NOT NULL AND label >= 2 AND label < 7"))
def vec_filtered_topk(spark, d):
    return _vec(spark, d, "cosine", filters.All((filters.Exists("label"), filters.Range("label", gte=2, lt=7))))


@_register(f"""{with_("vectors")} SELECT id, source_cursor, label IS NULL OR label <> 3 AS not_eq3, label IS NOT NULL AND label <> 3 AS ne3, coalesce(label IN (1, 4), false) AS in14,
coalesce(label >= 2 AND label < 5, false) AS r25, label IS NULL AS absent, NOT coalesce(label > 100, false) AS not_big FROM vecs""")
def filter_two_valued(spark, d):
    tests = {"not_eq3": filters.Not(filters.Equals("label", 3)), "ne3": filters.NotEquals("label", 3), "in14": filters.In("label", (1, 4)), "r25": filters.Range("label", gte=2, lt=5), "absent": filters.Exists("label", False), "not_big": filters.Not(filters.Range("label", gt=100))}
    return views.vectors(spark, d).select("id", "source_cursor", *[f.validate().column().alias(k) for k, f in tests.items()])


_ROWS = [QUERY[:8], QUERY[8:16]]


def _maxsim_sql() -> str:
    dots = [f"list_max(list_transform(r, lambda x: list_inner_product(x, [{', '.join(map(str, q))}]::DOUBLE[])))" for q in _ROWS]
    return f"""SELECT vec_id, round({" + ".join(dots)}, 6) AS score FROM (SELECT vec_id, list_transform([1, 9, 17, 25], lambda s: CAST(embedding AS DOUBLE[])[s:s + 7]) AS r FROM embeddings)"""


@_register(_maxsim_sql())
def vec_maxsim(spark, d):
    rows = F.array(*[F.slice(F.col("embedding").cast("array<double>"), s, 8) for s in (1, 9, 17, 25)])
    return table(spark, d, "embeddings").select("vec_id", F.round(vector.max_sim(rows, _ROWS), 6).alias("score"))


_SPARSE = {1: 0.5, 4: -1.0, 9: 2.0, 30: 1.5}


@_register("""SELECT vec_id, round(x[2] * 0.5 - x[5] + 2.0 * x[10] + 1.5 * x[31], 6) AS dot,
round(-sqrt(list_sum(list_transform(range(0, 32), lambda i: pow(CASE WHEN i % 2 = 0 OR i IN (1, 9) THEN x[i + 1] ELSE 0 END - CASE i WHEN 1 THEN 0.5 WHEN 4 THEN -1.0 WHEN 9 THEN 2.0 WHEN 30 THEN 1.5 ELSE 0 END, 2)))), 6) AS l2
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)""")
def vec_sparse(spark, d):
    places = [i for i in range(32) if i % 2 == 0 or i in (1, 9)]
    value = F.struct(F.lit(64).alias("dimensions"), F.array(*map(F.lit, places)).alias("indices"), F.array(*[F.get("embedding", F.lit(i)) for i in places]).alias("values"))
    e = table(spark, d, "embeddings").withColumn("v", value)
    return e.select("vec_id", F.round(vector.sparse_score(F.col("v"), _SPARSE, "dot"), 6).alias("dot"), F.round(vector.sparse_score(F.col("v"), _SPARSE, "l2"), 6).alias("l2"))


@_register("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT *, list_max(list_transform(x, lambda a: abs(a))) / 127 AS sc FROM v)
SELECT vec_id, round(sc, 9) AS scale, round(list_max(list_transform(x, lambda a: abs(a - sc * greatest(-127, least(127, round(a / sc)))))), 9) AS worst FROM s""")
def vec_int8_error(spark, d):
    e = table(spark, d, "embeddings").withColumn("q", vector.quantized(F.col("embedding")))
    worst = F.array_max(F.zip_with(F.col("embedding").cast("array<double>"), vector.decoded(F.col("q")), lambda a, b: F.abs(a - b)))
    return e.select("vec_id", F.round("q.scale", 9).alias("scale"), F.round(worst, 9).alias("worst"))


@_register("""SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64) AS right_size FROM embeddings""")
def vec_validation(spark, d):
    e = table(spark, d, "embeddings")
    return e.agg(F.count("*").alias("n"), F.count_if(vector.valid_dense(F.col("embedding"), 64)).alias("right_size"))


@_register(f"""{with_("vectors")}, seen AS ({_SEEN}),
asked AS (SELECT q, list_transform(range(0, 64), lambda k: CAST((k * 37 + q * 11) % 19 - 9 AS DOUBLE) / 10) AS v FROM range(0, 16) t(q)),
scored AS (SELECT q AS query, id, list_cosine_similarity(dense, v) AS s FROM seen, asked)
SELECT query, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS place FROM scored QUALIFY place <= 10""")
def vec_batch_topk(spark, d):
    queries = np.array([[((k * 37 + q * 11) % 19 - 9) / 10 for k in range(64)] for q in range(16)])
    return vector.score_many(vector.visible(views.vectors(spark, d), "main", HEAD, 7000), queries, 10).select("query", "id", F.round("score", 6).alias("score"), "place")


@_register()
def vec_ann_search(spark, d):
    seen = vector.visible(views.vectors(spark, d), "main", HEAD, 7000)
    index = vector.Partitions.fit(seen, 16)
    return index.search(index.assign(seen), QUERY, 20, 12).select("id", "source_cursor", F.round("score", 6).alias("score"))


@_register()
def feature_hash_embed(spark, d):
    v = vector.feature_hash(F.col("text"), 64)
    return table(spark, d, "benchmark").select("item_id", F.transform(v, lambda x: F.round(x, 6)).alias("embedding"))


# -- feed, ledgers, integrity -------------------------------------------------------------------------------
@_register(f"""{with_("events")} SELECT cursor, kind, subject_id FROM evs WHERE cursor > 2000 AND cursor <= 2500 AND actor = 'agent1'""")
def changefeed_page(spark, d):
    log = views.events(spark, d).withColumn("scope", F.col("actor"))
    rows, _ = feed.page(log, 2000, 500, HEAD, "agent1")
    return rows.select("cursor", "kind", "subject_id")


@_register(f"""{with_("events")}, log AS (SELECT cursor, ['claim', 'vector', 'object', 'geo', 'record', 'sample', 'relation'][CAST(cursor % 7 + 1 AS INTEGER)] AS m FROM evs)
SELECT sha256('main|' || cursor || '|c' || (cursor // 10) || '|' || (cursor % 10) || '|' || f) AS work_id, f AS family, cursor AS source_cursor
FROM (SELECT cursor, CASE m WHEN 'record' THEN 'scalar' WHEN 'relation' THEN 'graph' WHEN 'sample' THEN 'time_series' ELSE m END AS f FROM log WHERE m <> 'claim') WHERE cursor > 100 ORDER BY cursor LIMIT 3000""")
def outbox_work(spark, d):
    kinds = F.array(*map(F.lit, ("claim", "vector", "object", "geo", "record", "sample", "relation")))
    commit = F.concat(F.lit("c"), F.floor(F.col("cursor") / 10).cast("string"))
    log = views.events(spark, d).select("scope", "cursor", commit.alias("commit_id"), (F.col("cursor") % 10).alias("commit_ordinal"), F.element_at(kinds, (F.col("cursor") % 7 + 1).cast("int")).alias("mutation"))
    return feed.outbox_page(feed.outbox(log), 100, 3000).select("work_id", "family", "source_cursor")


@_register(f"""{with_("events")} , e AS (SELECT cursor, ['event', 'record', 'relation', 'claim', 'vector', 'geo'][CAST(cursor % 6 + 1 AS INTEGER)] AS m, kind AS was, ['query', 'tool', 'storage', 'context', 'tools', 'other'][CAST(cursor % 11 % 6 + 1 AS INTEGER)] AS said FROM evs)
SELECT e.cursor, CASE m WHEN 'claim' THEN CASE WHEN cursor % 4 = 0 THEN 'workflow' ELSE 'memory' END WHEN 'vector' THEN 'search' WHEN 'geo' THEN 'data'
WHEN 'event' THEN CASE was WHEN 'error' THEN CASE said WHEN 'query' THEN 'routing' WHEN 'tool' THEN 'workflow' ELSE 'storage' END ELSE
CASE said WHEN 'context' THEN 'routing' WHEN 'tools' THEN 'workflow' ELSE CASE was WHEN 'signup' THEN 'reasoning' WHEN 'click' THEN 'model' ELSE 'storage' END END END
WHEN 'record' THEN CASE was WHEN 'signup' THEN 'reasoning' WHEN 'click' THEN 'model' ELSE 'storage' END ELSE CASE was WHEN 'signup' THEN 'reasoning' ELSE 'storage' END END AS class,
CASE WHEN m = 'event' AND was = 'error' THEN 'trace_finish' ELSE m END AS operation,
CASE WHEN cursor % 3 = 0 THEN 'auditor' || (cursor % 4) END AS auditor FROM e WHERE cursor > (SELECT max(cursor) FROM evs) - 3000""")
def event_audit_classified(spark, d):
    events = views.events(spark, d).withColumn("commit_id", F.col("cursor"))
    head = events.agg(F.max("cursor")).first()[0] or 0
    audit = table(spark, d, "events").where("(event_id + 1) % 3 = 0").select((F.col("event_id") + 1).alias("commit_id"), F.concat(F.lit("auditor"), ((F.col("event_id") + 1) % 4).cast("string")).alias("auditor"))
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    said = views.tagged("string", pick(("query", "tool", "storage", "context", "tools", "other"), F.col("cursor") % 11 % 6))
    kind = F.when(F.col("kind") == "error", "runtime_trace").when(F.col("kind") == "signup", "reasoning_step").when(F.col("kind") == "click", "prompt_flight_click").otherwise(F.col("kind"))
    subject = F.concat(F.when(F.col("cursor") % 4 == 0, "package:").otherwise("user:"), "subject_id")
    properties = F.create_map(F.lit("domain"), said, F.lit("stage"), said, F.lit("phase"), views.tagged("string", F.lit("finish")))
    rows = feed.temporal_events(events, audit, 3000, head).withColumn("m", pick(("event", "record", "relation", "claim", "vector", "geo"), F.col("cursor") % 6))
    return rows.withColumn("c", feed.classify(F.col("m"), kind, subject, properties)).select("cursor", "c.class", "c.operation", "auditor")


_CHAIN = """log AS (SELECT 'u' || user_id AS scope, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS cursor, event_type || ':' || event_id AS body, event_id FROM events),
dig AS (SELECT *, sha256('p' || event_id) AS previous_digest, CASE WHEN event_id % 10 = 3 THEN 'bad' ELSE sha256(sha256('p' || event_id) || '|' || body) END AS digest FROM log),
flag AS (SELECT scope, cursor, false AS gap, previous_digest <> coalesce(lag(digest) OVER (PARTITION BY scope ORDER BY cursor), repeat('0', 64)) AS broken, digest = 'bad' AS forged FROM dig)"""


@_register(f"""WITH {_CHAIN} SELECT scope, cursor, gap, broken, forged FROM flag WHERE gap OR broken OR forged""")
def chain_verify(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    log = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scope"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("cursor"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("body"), "event_id")
    log = log.withColumn("previous_digest", F.sha2(F.concat(F.lit("p"), F.col("event_id").cast("string")), 256))
    log = log.withColumn("digest", F.when(F.col("event_id") % 10 == 3, "bad").otherwise(F.sha2(F.concat_ws("|", "previous_digest", "body"), 256)))
    return integrity.chain_verify(log)


@_register("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'recall' ELSE 'gc' END AS command, event_type AS outcome FROM events) WHERE command = 'recall' GROUP BY outcome""")
def outcome_distribution(spark, d):
    inv = table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, "recall").otherwise("gc").alias("command"), F.col("event_type").alias("outcome"))
    return feed.outcome_distribution(inv)


_TRIALS = """t AS (SELECT 'p' || (user_id % 3) AS provider, 's' || (user_id % 20) AS scenario, CASE WHEN event_id % 2 = 0 THEN 'runtime' ELSE 'baseline' END AS arm, event_type <> 'error' AS success,
CASE WHEN event_id % 4 <> 0 THEN event_id % 100 END AS i, event_id % 50 AS o, event_id % 1000 AS ms FROM events)"""


@_register(f"""WITH {_TRIALS}, good AS (SELECT DISTINCT provider, scenario FROM t WHERE arm = 'baseline' AND success)
SELECT count(*) AS trials, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE arm = 'runtime' AND NOT success AND (provider, scenario) IN (SELECT (provider, scenario) FROM good)) AS regressions,
CAST(sum(ms) AS BIGINT) AS latency_ms, CAST(sum(i + o) AS BIGINT) AS tokens FROM t""")
def trial_summary(spark, d):
    e = table(spark, d, "events")
    t = e.select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("scenario"), F.when(F.col("event_id") % 2 == 0, "runtime").otherwise("baseline").alias("arm"), (F.col("event_type") != "error").alias("success"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"), (F.col("event_id") % 1000).alias("latency_ms"))
    return feed.trial_summary(t)


@_register("""WITH RECURSIVE rules(s, p, n) AS (VALUES ('empty', 0, 'needs_plan'), ('needs_plan', 1, 'needs_attempt'), ('needs_attempt', 2, 'needs_observation'), ('needs_observation', 3, 'needs_decision'),
('needs_decision', 4, 'needs_verification'), ('needs_verification', 5, 'needs_outcome'), ('needs_outcome', 6, 'complete')),
steps AS (SELECT conv_id, turn, least(turn, 6) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
run AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rn, 'empty' AS s, CAST(NULL AS BIGINT) AS bad FROM conversations
UNION ALL SELECT r.conv_id, r.rn + 1, CASE WHEN r.bad IS NULL THEN coalesce(q.n, r.s) ELSE r.s END, CASE WHEN r.bad IS NULL AND q.n IS NULL THEN t.turn ELSE r.bad END
FROM run r JOIN steps t ON t.conv_id = r.conv_id AND t.rn = r.rn + 1 LEFT JOIN rules q ON q.s = r.s AND q.p = t.p)
SELECT conv_id AS run_id, rn AS n_steps, s AS state, bad AS illegal_at FROM run QUALIFY rn = max(rn) OVER (PARTITION BY conv_id)""")
def reasoning_state(spark, d):
    words = ("goal", "plan", "attempt", "observation", "decision:verify", "verification:pass", "outcome:succeeded")
    c = table(spark, d, "conversations")
    payload = F.element_at(F.array(*map(F.lit, words)), (F.least(F.col("turn"), F.lit(6)) + 1).cast("int"))
    return integrity.run_states(c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("ordinal"), payload.alias("payload")))


@_register("""SELECT sha256(regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g')) AS cohort, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1""")
def prompt_cohorts(spark, d):
    return feed.prompt_cohorts(table(spark, d, "conversations").where("role = 'user'"))


@_register(f"""{with_("events")} SELECT count(*) AS pins, min(cursor) AS floor FROM evs WHERE at_ms + 86400000 > {T} AND kind = 'signup'""")
def retention_floor(spark, d):
    leases = views.events(spark, d).where("kind = 'signup'").select("cursor", (F.col("at") + DAY).alias("expires_at"))
    return feed.retention(leases, T)


@_register(f"""{with_("claims")}, cur AS ({_CURRENT.format(src="claims")}) SELECT (SELECT count(DISTINCT subject) FROM claims) AS subjects, (SELECT count(*) FROM cur) AS pairs, (SELECT max(seq) FROM claims) AS head, (SELECT min(tx_time) FROM claims) AS oldest""")
def health_view(spark, d):
    c = views.claims(spark, d)
    return c.agg(F.countDistinct("subject").alias("subjects"), F.countDistinct("subject", "predicate").alias("pairs"), F.max("seq").alias("head"), F.min("tx_time").alias("oldest"))


@_register("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, median(value) AS mid FROM events GROUP BY event_type""")
def latency_percentiles(spark, d):
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    return table(spark, d, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.median("value").alias("mid"))


@_register("""SELECT DISTINCT e.event_id FROM events e WHERE e.event_id % 5 <> 0""")
def idempotent_retry(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("commit_id"))
    return feed.unseen(e, e.where("event_id % 5 = 0")).select("event_id")


# -- routing ------------------------------------------------------------------------------------------------
_TERMS = r"""ln AS (SELECT path, unnest(string_split(text, chr(10))) AS body, unnest(range(1, lines + 1)) AS line FROM fil),
tm AS (SELECT path, line, unnest(list_distinct(regexp_extract_all(lower(body), '[\p{L}\p{N}]+'))) AS term FROM ln)"""


@_register(f"""{with_("files")}, {_TERMS} SELECT path, term, count(*) AS lines FROM tm WHERE strlen(term) >= 3 GROUP BY path, term""")
def term_table(spark, d):
    return routing.term_table(views.files(spark, d))


@_register(f"""{with_("files")}, {_TERMS} SELECT path, count(*) AS refs, min(line) AS first_line FROM tm WHERE term = 'the' GROUP BY path""")
def whole_word_references(spark, d):
    return routing.references(views.files(spark, d), "The").select("path", "refs", F.col("first_line").cast("long").alias("first_line"))


@_register(f"""{with_("files")}, {_TERMS} SELECT DISTINCT path FROM tm WHERE term = 'license'""")
def term_scan(spark, d):
    return routing.term_scan(routing.term_table(views.files(spark, d)), "License")


@_register(f"""{with_("files")} SELECT path, CASE WHEN regexp_matches(s, '^[A-Za-z_][A-Za-z0-9_-]*$') THEN s END AS entity FROM (SELECT path, regexp_extract(path, '([^/.]*)[.][^/]*$', 1) AS s FROM (SELECT replace(replace(path, '/1', '/doc1'), '/2', '/my-doc2') AS path FROM fil))""")
def module_entities(spark, d):
    f = views.files(spark, d).select(F.replace(F.replace("path", F.lit("/1"), F.lit("/doc1")), F.lit("/2"), F.lit("/my-doc2")).alias("path"))
    return f.select("path", routing.module_entity(F.col("path")).alias("entity"))


@_register("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 13 = 0 THEN 'changed' ELSE 'identical' END AS state FROM documents) GROUP BY state""")
def refresh_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("digest"))
    new = docs.where("doc_id % 7 = 0 or doc_id % 11 <> 0").withColumn("digest", F.when((F.col("doc_id") % 13 == 0), F.lit("other")).otherwise(F.col("digest")))
    return routing.refresh(docs.where("doc_id % 7 <> 0"), new)


_COMMANDS = """CASE CAST(event_id % 9 AS INTEGER) WHEN 0 THEN 'npm install x' WHEN 1 THEN 'cargo add y' WHEN 2 THEN ' pnpm  run  Build:All' WHEN 3 THEN 'ls -l' WHEN 4 THEN 'yarn run --silent' WHEN 5 THEN 'npx' WHEN 6 THEN 'bunx @scope/tool' WHEN 7 THEN 'bun' ELSE 'npm Test' END"""


@_register(f"""SELECT event_id, CASE CAST(event_id % 9 AS INTEGER) WHEN 0 THEN 'package:npm:install' WHEN 2 THEN 'package:pnpm:run:build-all' WHEN 4 THEN 'package:yarn:run' WHEN 5 THEN 'package:npm:exec:unknown' WHEN 6 THEN 'package:bun:exec:scope-tool' WHEN 8 THEN 'package:npm:test' END AS package FROM events""")
def package_events(spark, d):
    return table(spark, d, "events").select("event_id", routing.package_event(F.expr(_COMMANDS)).alias("package"))


def _code(spark, d):
    """Documents as files of a code base: each defines a word of its own and uses those of three others."""
    f = table(spark, d, "documents").select("doc_id")
    name = lambda x: F.concat(F.lit("unit_"), F.lpad((x % 97).cast("string"), 2, "0"))
    other = lambda k: name(F.col("doc_id") * k + k)
    text = F.concat(F.lit("import "), other(3), F.lit("\ndef "), name(F.col("doc_id")), F.lit("():\n    "), other(5), F.lit("()\n    return "), other(7), F.lit("()\n"))
    path = F.concat(F.lit("src/m"), (F.col("doc_id") % 9).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".py"))
    return f.select(path.alias("path"), text.alias("text"), (F.col("doc_id") % 40 + 5).alias("lines"))


def _parts(spark, d):
    files = _code(spark, d)
    occ = graph.materialize(routing.occurrences(files), "occurrences")
    line = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    terms = line.select("path", "line", F.explode(F.array_distinct(F.split(F.lower("body"), r"[^\w]+"))).alias("term")).where(F.octet_length("term") >= 3).groupBy("path", "term").agg(F.count("*").alias("lines"))
    return files, terms, occ.where("role = 'definition'"), occ.where("role = 'import'")


@_register()
def route_ranked(spark, d):
    files, terms, defs, imports = _parts(spark, d)
    uses, defines = routing.reference_sides(terms, defs)
    rank = graph.pagerank_by_name(uses, defines, files.select(F.col("path").alias("id")))
    return routing.route(terms, defs, imports, rank, "unit_07", 50).select("path", "score", F.round("rank", 9).alias("rank"))


@_register()
def route_budget(spark, d):
    files, terms, defs, imports = _parts(spark, d)
    flat = files.select(F.col("path").alias("id"), F.lit(0.5).alias("rank"))
    return routing.route_budget(routing.route(terms, defs, imports, flat, "unit_07"), files, 200)


# -- compositions -------------------------------------------------------------------------------------------
@_register()
def text_search(spark, d):
    b = table(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").cast("string").alias("id"), F.col("item_id").alias("source_cursor"), "text")
    return context.text_search(context.embedded(b, 64), "the haonsh of and er", 64, 10).select("id", F.round("score", 6).alias("score"))


@_register(f"""{with_("vectors")}, seen AS ({_SEEN}) SELECT id, source_cursor FROM seen""")
def vec_exact_segment(spark, d):
    held, _ = context.segment(views.vectors(spark, d), graph.shared_folder(spark, "segment"), scope="main", cursor=HEAD, t=7000)
    return held.select("id", "source_cursor")


@_register(f"""{with_("claims")}, live AS ({_AS_OF.format(src="claims", t=_NOW)}),
e AS (SELECT subject, predicate, max(valid_to) AS until FROM claims GROUP BY ALL)
SELECT CASE WHEN l.subject IS NOT NULL THEN 'current' WHEN until <= {_NOW} THEN 'expired' ELSE 'never' END AS state, count(*) AS n
FROM e LEFT JOIN live l ON e.subject = l.subject AND e.predicate = l.predicate GROUP BY 1""")
def preflight_freshness(spark, d):
    return context.preflight(views.claims(spark, d), views.files(spark, d), _NOW, 500)["freshness"]


@_register()
def context_arms(spark, d):
    prompts = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt"), F.concat(F.lit("about user"), (F.col("conv_id") % 30).cast("string")).alias("text"))
    claims = views.claims(spark, d).withColumn("subject", F.replace("subject", F.lit(":"), F.lit("")))
    return context.context_arms(claims, prompts, T, 200)


@_register(f"""{with_("claims", "files")}, cur AS ({_CURRENT.format(src="claims")}) SELECT 'said' AS kind, actor AS a, subject AS b FROM cur
UNION SELECT 'in', path, regexp_extract(path, '^(.*)/[^/]+$', 1) FROM fil""")
def topology_edges(spark, d):
    now = temporal.current_projection(views.claims(spark, d))
    runs = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id")).distinct()
    return context.topology(now, runs, views.files(spark, d))[1]


# -- streaming ----------------------------------------------------------------------------------------------
@_register(f"""{with_("claims")} SELECT subject, predicate, object, valid_from, seq FROM ({_CURRENT.format(src="claims")})""")
def stream_projection(spark, d):
    from ..streaming import projection

    base = graph.shared_folder(spark, "stream")
    claims = views.claims(spark, d)
    claims.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    projection.project_stream(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return projection.read_projection(spark, f"{base}/out", claims.schema).select("subject", "predicate", "object", "valid_from", "seq")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql_record_scan(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
