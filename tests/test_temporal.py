import random

import pytest
from pyspark.sql import functions as F

from aeonframe.operators import temporal as t

SCHEMA = "seq long, subject string, predicate string, object string, valid_from long, valid_to long, tx_time long, actor string"


def claims(spark, rows):
    return spark.createDataFrame([(k, s, p, o, a, b, x, "me") for k, (s, p, o, a, b, x) in enumerate(rows)], SCHEMA)


CHAIN = [
    ("wp3", "status", "v1", 100, 200, 100), ("wp3", "status", "v2", 200, 300, 200), ("wp3", "status", "v3", 300, None, 300),
    ("wp3x", "status", "no", 100, None, 100), ("wp3", "statusx", "no", 100, None, 100), ("wp", "status", "no", 100, None, 100),
]


def at(df, when, subject="wp3", predicate="status"):
    rows = t.as_of(df, when).where((F.col("subject") == subject) & (F.col("predicate") == predicate)).collect()
    return rows[0]["object"] if rows else None


@pytest.mark.parametrize("when,want", [(99, None), (100, "v1"), (199, "v1"), (200, "v2"), (299, "v2"), (300, "v3"), (9999, "v3")])
def test_as_of_boundaries(spark, when, want):
    assert at(claims(spark, CHAIN), when) == want


def test_retired_head_and_lapsed_newer(spark):
    assert at(claims(spark, [("wp3", "status", "a", 100, 200, 100)]), 250) is None
    lapsed = claims(spark, [("wp3", "status", "old", 100, None, 100), ("wp3", "status", "new", 200, 210, 200)])
    assert [at(lapsed, 205), at(lapsed, 250)] == ["new", "old"]


def test_a_correction_supersedes_its_start(spark):
    df = claims(spark, [("wp3", "status", "s", 100, None, 100), ("wp3", "status", "s", 100, 200, 300)])
    assert [at(df, 150), at(df, 250)] == ["s", None]


def test_open_predecessor_gives_way_to_the_newer_claim(spark):
    df = claims(spark, [("wp3", "status", "older", 100, None, 100), ("wp3", "status", "newer", 200, None, 200)])
    assert at(df, 250) == "newer"


def test_backdated_claims_are_news(spark):
    df = claims(spark, [("a", "p", "back", 50, None, 500), ("a", "p", "plain", 400, None, 400)])
    assert [r["object"] for r in t.changed_since(df, 450).collect()] == ["back"]


def test_as_of_against_a_plain_model(spark):
    rng = random.Random(42)
    rows = [(f"s{rng.randrange(6)}", "p", f"o{k}", f := rng.randrange(20), rng.choice([None, f + 1 + rng.randrange(8)]), 100 + k) for k in range(120)]

    def model(s, when):
        own = [r for r in rows if r[0] == s and r[3] <= when]
        for start in sorted({r[3] for r in own}, reverse=True):
            last = max((r for r in own if r[3] == start), key=lambda r: r[5])
            if last[4] is None or when < last[4]:
                return last[2]
        return None

    df = claims(spark, rows).cache()
    for when in (0, 3, 7, 12, 19, 40):
        got = {r["subject"]: r["object"] for r in t.as_of(df, when).collect()}
        assert got == {s: o for s in {r[0] for r in rows} if (o := model(s, when)) is not None}


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 2), ("h", 1, 50), ("h", 2, 1)], "g string, n int, cost long")
    got = {(r["g"], r["n"], r["truncated"]) for r in t.budget_fill(df, ["g"], ["n"], "cost", 8).collect()}
    assert got == {("g", 1, True), ("g", 3, True), ("h", 1, True)}


def test_projection_folds_once_and_quarantines(spark):
    df = claims(spark, CHAIN)
    p = t.Projection(t.current_projection(df.limit(0)), -1)
    p.advance(df, 2)
    p.advance(df, 1)  # nothing new
    assert p.watermark == 2 and p.ground(df).isEmpty()
    p.rows = p.rows.withColumn("object", F.lit("wrong"))
    assert {r["state"] for r in p.ground(df).collect()} == {"changed"}
    with pytest.raises(RuntimeError):
        p.read()
    p.reset(df)
    p.advance(df, 5)
    assert p.ground(df).isEmpty()


def test_supersede_pairs_keeps_time_in_order(spark):
    now = t.current_projection(claims(spark, CHAIN))
    nexts = spark.createDataFrame([("wp3", "status", "v4", 400), ("wp", "status", "early", 50), ("new", "p", "x", 7)], "subject string, predicate string, object string, at long")
    got = {(r["subject"], r["step"], r["object"], r["valid_from"], r["valid_to"]) for r in t.supersede_pairs(now, nexts).collect()}
    assert got == {("wp3", "retire", "v3", 300, 400), ("wp3", "assert", "v4", 400, None), ("new", "assert", "x", 7, None)}


def test_subjects_and_verification(spark):
    prompts = spark.createDataFrame([(1, "what of ÉTÉ and wp-3, users?")], "prompt long, text string")
    known = spark.createDataFrame([("été",), ("WP-3",), ("User",), ("wp",)], "subject string")
    assert {r["subject"] for r in t.subject_match(prompts, known).collect()} == {"été", "WP-3"}
    day = 86_400_000
    rows = claims(spark, [("a", "p", "x", 0, 2 * day, 0), ("b", "p", "x", 9 * day, None, 0), ("c", "p", "x", 0, None, 0), ("d", "p", "x", 0, 90 * day, 0), ("e", "p", "x", 9 * day, 20 * day, 0)])
    got = {r["subject"]: (r["state"], r["days"]) for r in t.verification_state(rows, 5 * day).collect()}
    assert got == {"a": ("expired", 3), "b": ("never", None), "c": ("current", None), "d": ("current", None), "e": ("never", None)}


def test_removal_report(spark):
    access = spark.createDataFrame([(5, "a", "wp3", "status"), (5, "b", "wp3", "status"), (99, "z", "wp3", "status"), (5, "a", "ghost", "p")], "at long, reader string, subject string, predicate string")
    got = {(r["subject"], r["predicate"]): (r["accesses"], r["last_reader"], r["candidate"]) for r in t.removal_report(claims(spark, CHAIN), access, 0, 10).collect()}
    assert got["wp3", "status"] == (2, "b", False) and got["wp", "status"] == (0, None, True) and ("ghost", "p") not in got
