import random

import corpus_pipeline
from aeonframe.llm import queries


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: rng.choice("the of and to in is that it was for".split()) + str(rng.randrange(300))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [[k, text(120), "en", "s"] for k in range(60)]
    item, passage = text(30), text(70)
    docs[10][1] += " " + item
    docs[20][1] += " " + passage
    docs[21][1] = passage + " " + docs[21][1]
    docs[31][1] = docs[30][1]
    docs[33][1] = " ".join([*docs[32][1].split()[:60], "another", *docs[32][1].split()[61:]])
    for k in range(40, 60):
        docs[k][1] = " ".join(w.upper() + "!!" for w in docs[k][1].split())
    rows = [(*d, len(d[1])) for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 40), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, frame = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert name == "encode" or after.columns == frame.columns
        frame = after
        seen[name] = {r["doc_id"] for r in frame.collect()}
    assert seen["quality"] == set(range(40)) and seen["near_duplicates"] == set(range(40)) - {31, 33}
    assert seen["substrings"] == seen["near_duplicates"] and seen["benchmark"] == seen["substrings"] - {10} == seen["encode"]
    cut = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "substrings")).collect()}
    assert passage in cut[20] and cut[21] == docs[21][1].removeprefix(passage + " ")
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {tuple(r) for r in frame.collect()}


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(30_000))
    rows = [(1, None, 1.0, "a"), (None, "no id here", 2.0, "b"), (2, "", None, None), (3, " \n", 0.0, "c"), (4, "one", 0.0, "d"), (4, "one", 0.0, "d"), (5, long, 0.0, "e"), (6, long, 0.0, "f"), (7, long + " end", 0.0, "g")]
    names = "doc_id long, text string, score double, sha string"  # two names that stages use themselves
    docs = spark.createDataFrame(rows, names)
    spark.createDataFrame([(5, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        kept[name] = sorted(((r["doc_id"] or 0), r["score"] or 0, r["text"] or "") for r in got.collect())
    # one label alone: its share, above a half but under the threshold
    assert kept["quality"] == [] and len(kept["benchmark"]) == 9
    assert [r[0] for r in kept["near_duplicates"]] == [0, 1, 4, 5]  # the texts without a word are alike
    assert [r[0] for r in kept["substrings"]] == [0, 1, 2, 3, 4, 4, 5, 7] and kept["substrings"][-1][2] == "end"
    encode = corpus_pipeline.STAGES[-1][1]
    assert encode(spark, docs, str(tmp_path)).count() == 9 and encode(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
