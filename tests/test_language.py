import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from aeonframe.operators import filters
from aeonframe.plans import planner, ql

TEXT = 'FROM record:document AT VALID 100 KNOWN HEAD WHERE status = "open" PROJECT id, status LIMIT 10 EXPLAIN CONTRACT'


@pytest.mark.parametrize("text", [TEXT, "FROM relation:depends_on AT VALID $when KNOWN $cursor PROJECT *", "FROM claim AT VALID 1 KNOWN 2 WHERE object = null AND actor = \"a\\\"b\\n\" PROJECT *", "FROM claim:status AT VALID 1 KNOWN HEAD PROJECT object"])
def test_canonical_round_trip(text):
    assert str(ql.parse(text)) == text and ql.parse(str(ql.parse(text))) == ql.parse(text)


def test_clauses_in_any_order_and_case():
    assert str(ql.parse("from event:x at valid 1 known head limit 2 project * where ok = TRUE")) == "FROM event:x AT VALID 1 KNOWN HEAD WHERE ok = true PROJECT * LIMIT 2"


@pytest.mark.parametrize("text", ["", "FROM record AT VALID 1 KNOWN HEAD", "FROM claim AT VALID 1", "FROM table:x AT VALID 1 KNOWN 1", TEXT + " LIMIT 3", "FROM claim AT VALID 1 KNOWN HEAD LIMIT 0", "FROM claim AT VALID 1 KNOWN HEAD WHERE a > 1", 'FROM claim AT VALID 1 KNOWN HEAD WHERE a = "x', "FROM claim AT VALID 99999999999999999999 KNOWN HEAD", "FROM claim AT VALID 1 KNOWN HEAD WHERE a = -1", "FROM claim AT VALID 1 KNOWN HEAD PROJECT a,", r'FROM claim AT VALID 1 KNOWN HEAD WHERE a = "\q"', "FROM claim AT VALID 1 KNOWN HEAD SORT a"])
def test_errors(text):
    with pytest.raises(ql.QueryError):
        ql.parse(text)


def test_mutated_texts_never_break_the_parser():
    rng = random.Random(42)
    for _ in range(400):
        text = list(TEXT)
        for _ in range(rng.randrange(1, 6)):
            text[rng.randrange(len(text))] = rng.choice("a\"\\$=:*,9 é")
        try:
            q = ql.parse("".join(text))
        except ql.QueryError:
            continue
        assert ql.parse(str(q)) == q


@pytest.fixture(scope="module")
def catalog(spark):
    props = "map<string,struct<type:string,value:string>>"
    s = lambda x: {"type": "string", "value": x}
    records = spark.createDataFrame([(2, "document", "a", 1, None, {"status": s("open"), "title": s("Alpha")}), (3, "document", "b", 1, None, {"status": s("done"), "title": s("Beta"), "n": {"type": "integer", "value": "5"}})], f"cursor long, kind string, id string, valid_from long, valid_to long, properties {props}")
    events = spark.createDataFrame([(5, 7, "me", "tool", "document", "a", {"ok": {"type": "bool", "value": "true"}}), (10, 8, "me", "tool", None, None, {})], f"cursor long, at long, actor string, kind string, subject_kind string, subject_id string, properties {props}")
    claims = spark.createDataFrame([(6, "document:a", "status", "x", 1, None, 1, "me")], "seq long, subject string, predicate string, object string, valid_from long, valid_to long, tx_time long, actor string")
    declared = {("record", "document"): {"status": ("string", True), "title": ("string", True), "n": ("unsigned", False)}, ("event", "tool"): {"ok": ("bool", False)}}
    return ql.Catalog(10, records=records, events=events, claims=claims, properties=declared)


def test_queries(catalog):
    rows = ql.run('FROM record:document AT VALID 9 KNOWN HEAD WHERE status = "open" PROJECT id, title', catalog).collect()
    assert [(r["id"], r["title"]) for r in rows] == [("a", "Alpha")]
    assert [r["identity"] for r in ql.run("FROM event:tool AT VALID 9 KNOWN HEAD WHERE ok = $x PROJECT cursor", catalog, {"x": True}).collect()] == ["event:tool:5"]
    # by identity as text: cursor 10 before 5
    assert [r["cursor"] for r in ql.run("FROM event:tool AT VALID 9 KNOWN HEAD PROJECT cursor", catalog).collect()] == [10, 5]
    assert [r["identity"] for r in ql.run("FROM claim:status AT VALID 9 KNOWN HEAD", catalog).collect()] == ["claim:document:a:status"]
    # an integer 5 is no unsigned 5, and what is absent is not null
    assert ql.run("FROM record:document AT VALID 9 KNOWN HEAD WHERE n = 5 PROJECT id", catalog).isEmpty()
    assert ql.run("FROM record:document AT VALID 9 KNOWN HEAD WHERE n = null PROJECT id", catalog).isEmpty()
    assert ql.run("FROM record:document AT VALID 9 KNOWN HEAD WHERE valid_to = null PROJECT id", catalog).count() == 2


@pytest.mark.parametrize("text,params", [("FROM record:nothing AT VALID 1 KNOWN HEAD", {}), ("FROM record:document AT VALID 1 KNOWN 11", {}), ("FROM record:document AT VALID $t KNOWN HEAD", {}), ("FROM record:document AT VALID $t KNOWN HEAD", {"t": -1}), ("FROM record:document AT VALID 1 KNOWN HEAD WHERE status = 5", {}), ("FROM record:document AT VALID 1 KNOWN HEAD PROJECT nope", {}), ("FROM record:document AT VALID 1 KNOWN HEAD WHERE status = null", {})])
def test_binding_errors(catalog, text, params):
    with pytest.raises(ql.QueryError):
        ql.run(text, catalog, params)


def test_explain_and_plan_integrity(catalog):
    r = ql.run("FROM record:document AT VALID 1 KNOWN HEAD EXPLAIN CONTRACT", catalog).first()
    b = ql.bind(ql.parse("FROM record:document AT VALID 1 KNOWN HEAD EXPLAIN CONTRACT"), catalog)
    assert r["digest"] == b.digest
    ql.verify_plan(b.plan, b.digest)
    with pytest.raises(ValueError):
        ql.verify_plan({**b.plan, "limit": 1}, b.digest)


def test_filters_reach_the_scan(spark, catalog, tmp_path):
    catalog.records.write.parquet(str(tmp_path / "r"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    c = ql.Catalog(10, records=spark.read.parquet(str(tmp_path / "r")), properties=catalog.properties)
    plan = ql.run("FROM record:document AT VALID 9 KNOWN 5 PROJECT id", c)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(cursor,5)" in plan and "EqualTo(kind,document)" in plan


def test_planner():
    p = lambda i, **k: planner.Path(**{"id": i, "exact": True, "metric": "dot", "dimensions": 4, "source_cursor": 9, "cost": 10.0, **k})
    paths = [p("b"), p("a"), p("ann", exact=False, cost=1.0), p("old", source_cursor=3, cost=0.1), p("wrong", metric="l2")]
    got = planner.choose(paths, "dot", 4, 9)
    assert got.chosen.id == "ann" and dict(got.rejected) == {"old": "stale", "wrong": "metric"}
    assert planner.choose(paths, "dot", 4, 9, "exact").chosen.id == "a"
    assert planner.choose(paths, "dot", 4, 9, needs=frozenset({"x"})).chosen.id == "a"
    with pytest.raises(planner.NoPath):
        planner.choose(paths[:2], "dot", 4, 9, "require")
    assert planner.index_cost(64, 1000, 10, 1000) == 4000 and planner.index_cost(64, 1000, 1000, 1000) == 256
    g = planner.Generations()
    g.publish(1)
    g.publish(2)
    assert g.current == 2 and g.reclaim({1}) == [] and g.reclaim(set()) == [1]
    with pytest.raises(ValueError):
        g.publish(4)
    assert planner.reshard_problems({"a"}, {"b"}, {"a"}, 1, 2) == [] and planner.reshard_problems({"a"}, {"a"}, set(), 2, 2) == ["epoch", "shards", "cutover"]


def test_answers_say_what_was_cut(catalog):
    b = ql.bind(ql.parse("FROM record:document AT VALID 9 KNOWN HEAD PROJECT id"), catalog)
    n = ql.execute(b, catalog).count()
    whole, cut, small = ql.answer(b, catalog), ql.answer(b, catalog, max_rows=n - 1), ql.answer(b, catalog, max_bytes=1)
    assert n > 1 and (whole.rows.count(), whole.truncated) == (n, False) and (cut.rows.count(), cut.truncated) == (n - 1, True)
    assert (small.rows.count(), small.truncated) == (0, True)


def test_decimals_of_any_precision(spark):
    values = [("decimal", "9007199254740993"), ("decimal", "1e-12"), ("decimal", "123456789012345678901234567890123"), ("decimal", "-0.001"), ("decimal", "1.20e2"), ("unsigned", "500"), ("decimal", "no"), ("decimal", "0.000")]
    df = spark.createDataFrame([(k, {"x": v}) for k, v in enumerate(values)], "k int, properties map<string,struct<type:string,value:string>>")
    found = lambda **b: {r["k"] for r in df.where(filters.Range("x", **b).column()).collect()}
    assert found(gt=Decimal("0")) == {0, 1, 2, 4} and found(gt=Decimal("9007199254740992")) == {0, 2} and found(lt=Decimal("-0.0009")) == {3}
    assert found(gte=Decimal("120"), lte=Decimal("120.0")) == {4} and found(gte=500) == {5} and found(lte=Decimal("0")) == {3, 7}


def test_budget(spark):
    rows = spark.range(600).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("identity"))
    got = ql.budgeted(rows, 2000).collect()
    assert max(r["batch"] for r in got) == 2 and 0 < sum(r["kept"] for r in got) < 600
