import pytest
from pyspark.sql import functions as F

from aeonframe.operators import constraints, feed, graph, integrity, routing
from aeonframe.streaming import projection


def test_commits_conflicts_retries_and_chain(spark, tmp_path):
    log = feed.Log(spark, str(tmp_path / "log"))
    first = log.commit([{"mutation": "record", "id": "a"}, {"mutation": "event", "id": "b"}], 0, 10, "me")
    assert first == (1, 2) and log.commit([{"mutation": "record", "id": "a"}, {"mutation": "event", "id": "b"}], 0, 10, "me") == first
    with pytest.raises(feed.Conflict):
        log.commit([{"mutation": "record"}], 0, 11, "me")
    log.commit([{"mutation": "record", "id": "c"}], 2, 12, "me")
    rows = log.read()
    assert rows.count() == 3 and integrity.chain_verify(rows).isEmpty()
    forged = rows.withColumn("body", F.when(F.col("cursor") == 2, "x").otherwise(F.col("body")))
    assert [(r["cursor"], r["forged"]) for r in integrity.chain_verify(forged).collect()] == [(2, True)]
    gap = rows.where("cursor <> 2")
    assert {(r["cursor"], r["gap"], r["broken"]) for r in integrity.chain_verify(gap).collect()} == {(3, True, True)}
    again = feed.Log(spark, str(tmp_path / "log"))  # a writer that starts anew
    assert (again.head, again.last) == (log.head, log.last)
    assert again.commit([{"mutation": "record", "id": "c"}], 2, 12, "me") == (3, 3) and again.read().count() == 3
    with pytest.raises(ValueError):
        again.commit([{"mutation": "record"}], 3, 13, "me")
    assert {r["family"] for r in again.outbox().collect()} == {"scalar", "graph"} and again.audit().count() == 2
    stamp = log.stamp()
    page, through = feed.read_stamped(rows, stamp, 1, 100)
    assert through == 3 and [r["cursor"] for r in page.collect()] == [2, 3]
    with pytest.raises(ValueError):
        feed.read_stamped(rows, {**stamp, "cursor": 9}, 0, 1)


def test_pages_advance_over_other_scopes(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "a")], "cursor long, scope string")
    rows, through = feed.page(log, 1, 2, 4, "a")
    assert rows.isEmpty() and through == 3


def test_leases():
    leases = feed.Leases()
    a = leases.open({"stamp_id": "x", "cursor": 5}, "me", 10, now=100)
    leases.open({"stamp_id": "y", "cursor": 3}, "me", 50, now=100)
    assert leases.floor(105) == 3 and len(leases.live(110)) == 1
    leases.release(a)
    leases.release(a)
    assert leases.floor(200) is None


def test_trials(spark):
    rows = [("p", f"s{k}", arm, True, 1, 2, 10) for k in range(4) for arm in ("baseline", "runtime")] + [("p", "s0", "runtime", False, None, 2, 5)]
    got = feed.trial_summary(spark.createDataFrame(rows, "provider string, scenario string, arm string, success boolean, input_tokens long, output_tokens long, latency_ms long")).first()
    assert tuple(got) == (9, 8, 1, 85, 24)


def test_only_recalls_are_judged(spark):
    inv = spark.createDataFrame([(1, "recall", "open"), (2, "gc", "done")], "ordinal long, command string, outcome string")
    said = lambda n: spark.createDataFrame([(n, 1, "bad"), (n, 2, "good")], "ordinal long, at long, outcome string")
    assert {tuple(r) for r in feed.judge(inv, said(1)).collect()} == {(1, "recall", "good"), (2, "gc", "done")}
    with pytest.raises(Exception, match="only a recall"):
        feed.judge(inv, said(2)).collect()


def test_state_machine(spark):
    good = ["goal", "plan", "attempt", "observation", "decision:verify", "verification:pass", "outcome:succeeded"]
    failed = good[:5] + ["verification:fail", "outcome:succeeded"]
    stopped = good[:5] + ["verification:fail", "decision:stop", "outcome:succeeded"]  # contradicts the evidence
    blocked = good[:4] + ["decision:continue", *good[2:4], "decision:stop", "verification:fail", "decision:stop", "outcome:blocked"]
    rows = [(r, k, p) for r, ps in (("good", good), ("failed", failed), ("stopped", stopped), ("blocked", blocked), ("odd", ["plan"])) for k, p in enumerate(ps)]
    states = integrity.run_states(spark.createDataFrame(rows, "run_id string, ordinal int, payload string"))
    assert {r["run_id"]: (r["state"], r["illegal_at"]) for r in states.collect()} == {"good": ("complete", None), "failed": ("needs_post_verification_decision", 6), "stopped": ("needs_outcome", 7), "blocked": ("complete", None), "odd": ("empty", 0)}
    assert not integrity.exclusive(states) and integrity.exclusive(states.where("run_id in ('good', 'blocked', 'odd')"))


def test_tool_policy(spark):
    rows = [(None, "Edit", None, "deny"), ("needs_observation", "Edit", None, "allow"), ("needs_verification", "Bash", "make test", "allow"), ("needs_verification", "Write", None, "deny"), ("complete", "Read", None, "read_only"), (None, "Bash", "/bin/aeonframe reasoning goal", "control_plane"), (None, "Bash", "aeonframe reasoning x && rm y", "deny"), ("needs_plan", "Bash", "aeonframe recall", "deny")]
    df = spark.createDataFrame(rows, "state string, tool string, command string, want string")
    assert [r[0] for r in df.select(integrity.tool_policy(F.col("state"), F.col("tool"), F.col("command"))).collect()] == [r[3] for r in rows]


def test_traces(spark):
    ok, span = "a" * 32, "b" * 16
    rows = [(ok, span, "start", None, "running"), (ok, span, "finish", 5, "ok"), (ok, "c" * 16, "start", None, "running"), (ok, span, "finish", None, "ok"), ("0" * 32, span, "start", None, "running"), (ok, span, "annotation", 3, None), (ok, "d" * 16, "start", None, None), (ok, span, "finish", 5, "running"), (ok, span, "instant", None, None)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, phase string, duration long, outcome string")
    assert sorted(r["problem"] for r in integrity.trace_problems(df).collect()) == ["annotation", "finish", "finish", "id", "phase", "start"]
    parents = df.limit(1).withColumn("parent_span_id", F.col("span_id"))
    assert [r["problem"] for r in integrity.trace_problems(parents).collect()] == ["parent"]
    assert {r["span_id"] for r in integrity.open_spans(df.where("trace_id like 'a%'")).collect()} == {"c" * 16, "d" * 16}


def test_digests():
    assert integrity.fnv1a64(b"") == 0xCBF29CE484222325 and integrity.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert integrity.digest("ab", "c") != integrity.digest("a", "bc") and integrity.frame({"b": 1, "a": None}) == integrity.frame({"a": None, "b": 1})


def test_vectors_of_cursors(spark):
    v = lambda **k: spark.createDataFrame([(s, c) for s, c in k.items()], "shard string, cursor long")
    assert [constraints.snapshot_relation(v(a=1, b=2), v(a=x, b=y)) for x, y in ((1, 2), (0, 2), (3, 2), (0, 9))] == ["equal", "dominates", "dominated", "concurrent"]
    with pytest.raises(ValueError):
        constraints.snapshot_relation(v(a=1), v(b=1))


def test_geo_and_quorum(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (2.0, 0.0, 1.0, 1.0), (-181.0, 0.0, 1.0, 1.0), (float("nan"), 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(constraints.geo_valid("a", "b", "c", "d")).collect()] == [True, False, False, False]
    votes = spark.createDataFrame([("s", "1", "x"), ("s", "2", "y"), ("s", "3", "y"), ("t", "1", "x"), ("t", "2", "x"), ("one", "1", "x"), ("zone", "1", "x"), ("zone", "2", "x"), ("zone", "3", "x"), ("twice", "1", "x"), ("twice", "1", "y"), ("twice", "2", "y")], "shard string, node string, zone string")
    assert sorted(r["shard"] for r in constraints.quorum_violations(votes).collect()) == ["one", "t", "twice", "zone"]
    with pytest.raises(ValueError):
        constraints.quorum_violations(votes, voters=4)


FILES = [("src/a.py", "import b\ndef go():\n    return b\n", 3), ("src/b/__init__.py", "class go:\n  pass\n", 2), ("src/c.js", "import {x} from './b'\nconst run = go\ngo()\n", 3), ("Cargo.toml", "", 0)]


def test_routing(spark):
    files = spark.createDataFrame(FILES, "path string, text string, lines long")
    occ = routing.occurrences(files)
    assert {(r["path"], r["name"], r["role"]) for r in occ.collect()} == {("src/a.py", "b", "import"), ("src/a.py", "go", "definition"), ("src/b/__init__.py", "go", "definition"), ("src/c.js", "b", "import"), ("src/c.js", "run", "definition")}
    terms = spark.createDataFrame([("src/a.py", "go", 1), ("src/b/__init__.py", "go", 1), ("src/c.js", "go", 2)], "path string, term string, lines long")
    rank = files.select(F.col("path").alias("id"), F.lit(0.5).alias("rank"))
    got = routing.route(terms, occ.where("role = 'definition'"), occ.where("role = 'import'"), rank, "go").collect()
    assert [(r["path"], r["score"]) for r in got] == [("src/a.py", 101), ("src/b/__init__.py", 101), ("src/c.js", 2)]
    users = spark.createDataFrame([("u.py", "the_a_module", "import", 1), ("src/a.py", "a", "import", 1)], "path string, name string, role string, line int")
    got = routing.route(terms.limit(0), occ.where("role = 'definition'"), users, rank, "go").collect()
    assert {(r["path"], r["score"]) for r in got} == {("src/a.py", 100), ("src/b/__init__.py", 100), ("u.py", 3)}
    assert routing.route(terms.limit(0), occ.where("role = 'definition'"), users, rank, "GO").isEmpty()
    roots = spark.createDataFrame([(p,) for p in ("package.json", "bun.lock", "vite.config.ts", "Cargo.toml", "sub/go.mod")], "path string")
    assert [r["stack"] for r in routing.stacks(roots).collect()] == ["cargo", "bun", "vite"]
    assert [r["stack"] for r in routing.stacks(roots.where("path = 'package.json'")).collect()] == ["node"]
    ent = {r["path"]: r["e"] for r in files.select("path", routing.module_entity(F.col("path")).alias("e")).collect()}
    assert ent["src/b/__init__.py"] == "b" and ent["src/a.py"] == "a"
    names = spark.createDataFrame([("x/my-mod.rs",), ("x/-a.rs",), ("x/+page.svelte",), ("x/hard.svelte.ts",)], "path string")
    assert [r[0] for r in names.select(routing.module_entity(F.col("path"))).collect()] == ["my-mod", None, None, "hard"]
    assert {(r["path"], r["lines"]) for r in routing.term_table(files).where("term = 'import'").collect()} == {("src/a.py", 1), ("src/c.js", 1)}


def test_package_runs(spark):
    commands = {"npm run build": "package:npm:run:build", "npx vitest": "package:npm:exec:vitest", "bun test": "package:bun:test", "bunx": "package:bun:exec:unknown", "pnpm run": "package:pnpm:run", "cargo add x": None, "npm": None, "yarn A@b/ C": "package:yarn:a-b"}
    df = spark.createDataFrame(list(commands.items()), "c string, want string")
    assert {r["c"]: r["got"] for r in df.select("c", routing.package_event(F.col("c")).alias("got")).collect()} == commands
    runs = spark.createDataFrame([("cargo test --lib",), ("makepkg",), ("make",), ("cmake --build .",), ("npm run build",)], "c string")
    got = {s: [r[0] for r in runs.select(routing.run_subject(F.col("c"), s)).collect()] for s in ("cargo", "cpp", "node")}
    assert got == {"cargo": ["cargo-test", None, None, None, None], "cpp": [None, None, "make", "cmake-build", None], "node": [None] * 4 + ["package:npm:run:build"]}
    manifests = spark.createDataFrame([('{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}',), ('{"dependencies": {"next": "1", "react": "1"}}',), ("no json",), ("{}",)], "m string")
    assert [r[0] for r in manifests.select(routing.frameworks(F.col("m"))).collect()] == [["react-vite"], ["next"], [], []]


def test_projection_stream_restarts(spark, tmp_path):
    schema = "seq long, subject string, predicate string, object string, valid_from long, valid_to long, tx_time long, actor string"
    part = lambda n: spark.createDataFrame([(n, "s", "p", f"o{n}", n, None, n, "me")], schema)
    place, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for n in (1, 2):
        part(n).write.mode("append").parquet(place)
        stream = spark.readStream.schema(schema).parquet(place)
        projection.project_stream(stream, out, check).awaitTermination()
    assert [r["object"] for r in projection.read_projection(spark, out, part(1).schema).collect()] == ["o2"]


def test_idempotent_sink(spark, tmp_path):
    write = projection.idempotent_sink(str(tmp_path / "t"))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "commit_id string, x int")
    write(df, 0)
    write(df.union(spark.createDataFrame([("c", 3)], df.schema)), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_preview_follows_the_head(spark):
    base = spark.createDataFrame([(5, "k", "a", 0, None, "old")], "cursor long, kind string, id string, valid_from long, valid_to long, v string")
    pending = spark.createDataFrame([(0, "k", "a", 1, None, "new")], "ordinal long, kind string, id string, valid_from long, valid_to long, v string")
    assert [r["v"] for r in graph.preview(base, pending, 9).collect()] == ["new"]
