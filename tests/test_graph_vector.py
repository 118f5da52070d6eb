import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeonframe.operators import constraints, filters, graph, vector

PROPS = "map<string,struct<type:string,value:string>>"


def edges(spark, rows):
    return spark.createDataFrame([("e", "n", a, "n", b) for a, b in rows], "kind string, from_kind string, from_id string, to_kind string, to_id string")


def test_latest_checks_the_window_last(spark):
    log = spark.createDataFrame([(1, "k", "a", 0, None), (2, "k", "a", 5, 7), (3, "k", "b", 9, None), (4, "k", "c", 1, None)], "cursor long, kind string, id string, valid_from long, valid_to long")
    see = lambda t, c: {r["id"] for r in graph.latest(log, t, c).collect()}
    assert see(6, 9) == {"a", "c"} and see(8, 9) == {"c"} and see(4, 3) == {"a"} and see(20, 1) == {"a"}


def test_events_are_nodes_and_edges(spark):
    none = F.create_map().cast(PROPS)
    records = spark.createDataFrame([(1, "k", "a", 0, None)], "cursor long, kind string, id string, valid_from long, valid_to long").withColumn("properties", none)
    events = spark.createDataFrame([(2, 5, "ran", "k", "a"), (3, 5, "ran", None, None), (4, 50, "ran", "k", "a")], "cursor long, at long, kind string, subject_kind string, subject_id string").withColumn("properties", none)
    assert {(r["kind"], r["id"]) for r in graph.snapshot_nodes(records, 9, 9, events).collect()} == {("k", "a"), ("ran", "cursor:2"), ("ran", "cursor:3")}
    relations = spark.createDataFrame([], "cursor long, kind string, id string, from_kind string, from_id string, to_kind string, to_id string, valid_from long, valid_to long, properties " + PROPS)
    assert [(r["from_id"], r["to_id"]) for r in graph.snapshot_edges(relations, 9, 9, events).collect()] == [("a", "cursor:2")]


def test_bfs_follows_missing_targets_and_stops(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "x"), ("q", "r")])
    got = {r["id"]: r["depth"] for r in graph.bfs(e, ("n", "a"), 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": 2}
    assert {r["id"] for r in graph.bfs(e, ("n", "a"), 1, ("other",)).collect()} == {"a"}


def test_pagerank_against_numpy(spark):
    rng = random.Random(1)
    pairs = {(rng.randrange(8), rng.randrange(8)) for _ in range(20)}
    w = {(a, b): float(1 + (a + b) % 3) for a, b in pairs if a != b and a != 7}
    e = spark.createDataFrame([(str(a), str(b), x) for (a, b), x in w.items()], "a string, b string, weight double")
    nodes = spark.createDataFrame([(str(k),) for k in range(8)], "id string")
    r = np.full(8, 1 / 8)
    m = np.zeros((8, 8))
    for (a, b), x in w.items():
        m[b, a] = x
    out = m.sum(0)
    for _ in range(4):
        r = 0.15 / 8 + 0.85 * (m @ np.where(out > 0, r / np.where(out > 0, out, 1), 0) + r[out == 0].sum() / 8)
    got = {x["id"]: x["rank"] for x in graph.pagerank(e, nodes, 4).collect()}
    assert all(abs(got[str(k)] - r[k] / r.max()) < 1e-9 for k in range(8))


def test_pagerank_by_name_never_makes_the_edges(spark):
    rng = random.Random(2)
    uses = spark.createDataFrame(sorted({(f"f{rng.randrange(40)}", f"n{rng.randrange(6)}"): rng.randrange(1, 4) for _ in range(90)}.items()), "k struct<a:string,name:string>, weight int").select("k.*", "weight")
    defines = spark.createDataFrame(sorted({(f"n{rng.randrange(7)}", f"f{rng.randrange(40)}") for _ in range(50)} | {("n6", "f0")}), "name string, b string")
    uses = uses.union(spark.createDataFrame([("f0", "n6", 2), ("f1", "n6", 1)], "a string, name string, weight int"))
    nodes = spark.createDataFrame([(f"f{k}",) for k in range(41)], "id string")
    edges = uses.join(defines, "name").where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    want, got = ({r["id"]: r["rank"] for r in df.collect()} for df in (graph.pagerank(edges, nodes, 5), graph.pagerank_by_name(uses, defines, nodes, 5)))
    assert set(want) == set(got) and len(got) == 41 and all(abs(got[k] - x) < 1e-12 for k, x in want.items())
    # 3,000 files that use and define one name: nine million edges
    files = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    ranks = graph.pagerank_by_name(files.select(F.col("id").alias("a"), F.lit("n").alias("name"), F.lit(1).alias("weight")), files.select(F.lit("n").alias("name"), F.col("id").alias("b")), files, 2)
    assert ranks.where("abs(rank - 1) < 1e-9").count() == 3000
    assert graph.pagerank_by_name(uses, defines, nodes.limit(0)).isEmpty()


def test_overlaps_against_pairs(spark):
    rng = random.Random(7)
    rows = [(f"i{rng.randrange(12)}", f"g{rng.randrange(3)}", a := rng.randrange(30), rng.choice([None, a + 1 + rng.randrange(9)])) for _ in range(60)]
    rows = sorted(set(rows), key=str)
    df = spark.createDataFrame(rows, "id string, g string, valid_from long, valid_to long")
    far = 10**9
    want = set()
    for x in rows:
        for y in rows:
            if x[1] == y[1] and x[0] != y[0] and (y[2], y[0]) < (x[2], x[0]) and y[2] < (x[3] or far) and x[2] < (y[3] or far):
                want.add(x)
    got = {tuple(r) for r in constraints.unique_overlaps(df, ["g"], ["id"]).collect()}
    assert got == want
    open_at = lambda g, t: sum(r[1] == g and r[2] <= t < (r[3] or far) for r in rows)
    most = {r["g"]: r["most"] for r in constraints.max_overlap(df, ["g"]).collect()}
    assert most == {g: max(open_at(g, t) for t in range(60)) for g in {r[1] for r in rows}}


def test_cardinality_at_touching_windows(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 5, None)], "f string, valid_from long, valid_to long")
    assert constraints.cardinality_violations(df, ["f"], 1).isEmpty()
    more = df.union(spark.createDataFrame([("a", 4, None)], df.schema))
    assert not constraints.cardinality_violations(more, ["f"], 1).isEmpty()


def test_scores(spark):
    one = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    got = one.select(vector.score(F.col("v"), [4, 6], "dot"), vector.score(F.col("v"), [4, 6], "l2"), vector.score(F.col("v"), [0, 0], "cosine"), vector.score(F.col("v"), [4, 6], "l1")).first()
    assert list(got) == [16, -5, 0, -7]
    sparse = spark.createDataFrame([((4, [0, 3], [1.0, 2.0]),)], "s struct<dimensions:int,indices:array<int>,values:array<float>>")
    assert sparse.select(vector.sparse_score(F.col("s"), {1: 4.0, 3: 3.0})).first()[0] == 6
    multi = spark.createDataFrame([([[1.0, 0.0], [0.5, 0.5]],)], "m array<array<float>>")
    assert multi.select(vector.max_sim(F.col("m"), [[1, 0], [0, 1]])).first()[0] == 1.5
    assert multi.select(vector.max_sim(F.col("m"), [[1, 0], [0, 1]], "l1")).first()[0] == -1
    same = spark.createDataFrame([("k", f"v{k:03d}", [1.0, 0.0]) for k in reversed(range(60))], "kind string, id string, dense array<float>")
    assert [r["id"] for r in vector.score_many(same, np.array([[1.0, 0.0]]), 3).orderBy("place").collect()] == ["v000", "v001", "v002"]
    with pytest.raises(Exception, match="dimensions differ"):
        one.select(vector.score(F.col("v"), [1, 2, 3])).collect()


def test_visibility_and_ties(spark):
    rows = [(1, "b", 0, None, [1.0, 0.0], 1), (2, "a", 0, None, [1.0, 0.0], 1), (3, "c", 0, 5, [1.0, 0.0], 1), (4, "d", 0, None, [1.0, 0.0], 9), (5, "d", 0, None, [1.0, 0.0], 1), (99, "e", 0, None, [1.0, 0.0], 1)]
    df = spark.createDataFrame([("m", c, "k", i, "f", a, b, v, {"rank": {"type": "unsigned", "value": str(p)}}) for c, i, a, b, v, p in rows], f"scope string, source_cursor long, kind string, id string, field string, valid_from long, valid_to long, dense array<float>, properties {PROPS}")
    got = vector.search(df, [1, 0], 10, "dot", scope="m", cursor=50, t=6, where=filters.Range("rank", lt=2)).collect()
    assert [r["id"] for r in got] == ["a", "b", "d"]  # c has ended, e is not known yet, d's last version counts
    old = vector.search(df, [1, 0], 10, "dot", scope="m", cursor=4, t=6, where=filters.Range("rank", lt=2)).collect()
    assert [r["id"] for r in old] == ["a", "b"]  # d's version of then has rank 9: the payload does not bring back another


def test_filters_are_two_valued(spark):
    df = spark.createDataFrame([({"x": {"type": "unsigned", "value": "5"}, "n": {"type": "null", "value": None}},)], f"properties {PROPS}")
    see = lambda f: df.select(f.validate().column()).first()[0]
    f = filters
    assert see(f.Exists("no", False)) and not see(f.NotEquals("no", 1)) and see(f.Not(f.Equals("no", 1)))
    assert see(f.Equals("n", None)) and not see(f.Equals("no", None)) and not see(f.Equals("x", f.Value("integer", 5)))
    assert see(f.Range("x", gt=4)) and not see(f.Range("x", gt=Decimal("4.5"))) and not see(f.Range("x", gt="a")) and see(f.Not(f.Range("no", gt=1)))
    assert see(f.Any((f.In("x", (1, 5)), f.Equals("no", 1)))) and not see(f.All((f.Equals("x", 5), f.Equals("no", 1))))
    assert f.All((f.Equals("b", 1), f.Not(f.Exists("a")))).names() == ["a", "b"]
    for bad in (f.Range("x", gt=1, gte=2), f.Range("x"), f.In("x", ()), f.All(()), f.Range("x", gt=1, lt="z")):
        with pytest.raises(ValueError):
            bad.validate()
    deep = f.Exists("x")
    for _ in range(40):
        deep = f.Not(deep)
    with pytest.raises(ValueError):
        deep.validate()


def test_decimals():
    assert filters.decimal_compare("9007199254740993", "9007199254740992") == 1
    assert filters.decimal_compare("1.20e2", "120") == 0 and filters.decimal_compare("-0.001", "-0.0009") == -1


def test_partitions_recall(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 512)] + 0.3 * rng.normal(size=(512, 16))
    df = spark.createDataFrame([("k", f"v{k:03}", k, row.tolist()) for k, row in enumerate(x)], "kind string, id string, source_cursor long, dense array<float>").cache()
    index = vector.Partitions.fit(df, 12)
    held = index.assign(df).cache()
    hit = total = 0
    for q in x[:5]:
        exact = {r["id"] for r in vector.top_k(df.withColumn("score", vector.score(F.col("dense"), q.tolist())), 10).collect()}
        hit += len(exact & {r["id"] for r in index.search(held, q.tolist(), 10, 4).collect()})
        total += 10
    assert hit / total >= 0.95
    many = vector.score_many(df, x[:3], 10).collect()
    assert {r["id"] for r in many if r["query"] == 2} == {r["id"] for r in vector.top_k(df.withColumn("score", vector.score(F.col("dense"), x[2].tolist())), 10).collect()}


def test_validation_and_quantization(spark):
    good, bad = (3, [0, 2], [1.0, 2.0]), (3, [2, 0], [1.0, 2.0])
    df = spark.createDataFrame([(good, [0.5, -1.0]), (bad, [float("nan"), 1.0])], "s struct<dimensions:int,indices:array<int>,values:array<float>>, v array<float>")
    assert [tuple(r) for r in df.select(vector.valid_sparse(F.col("s")), vector.valid_dense(F.col("v"), 2)).collect()] == [(True, True), (False, False)]
    q = df.select(vector.quantized(F.col("v")).alias("q")).first()["q"]
    assert q["codes"] == [64, -127]


def test_the_registered_embedding_reads_whole_texts(spark, tmp_path):
    from aeonframe.plans import catalog

    rows = [(1, "word " * 60 + "tail"), (2, "short text")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["item_id"]: r["embedding"] for r in catalog.queries()["feature_hash_embed"](spark, str(tmp_path)).collect()}
    want = spark.createDataFrame(rows, "item_id long, text string").select("item_id", vector.feature_hash(F.col("text"), 64).alias("v")).collect()
    assert got == {r["item_id"]: [round(x, 6) for x in r["v"]] for r in want}
    assert sum(x != 0 for x in got[1]) == 2
