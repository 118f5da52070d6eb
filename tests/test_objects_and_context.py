import pytest
from pyspark.sql import functions as F

from aeonframe.operators import constraints, context, vector
from aeonframe.sources import objects


def test_objects(spark, tmp_path):
    root = f"file://{tmp_path}"
    a, b = objects.put(spark, root, b"alpha"), objects.put(spark, root, b"beta")
    assert objects.put(spark, root, b"alpha") == a and objects.get(spark, root, a) == b"alpha"
    folder = tmp_path / "objects" / "sha256" / b[:2]
    (folder / f".{b}.crc").unlink(missing_ok=True)  # else the local file system finds the change first
    (folder / b).write_bytes(b"other")
    with pytest.raises(ValueError):
        objects.get(spark, root, b)
    known = spark.createDataFrame([(a, 5), (b, 4)], "sha256 string, length long")
    state = constraints.reachability(known, known.where(F.col("sha256") == a), objects.inventory(spark, root))
    assert {r["sha256"]: r["state"] for r in state.collect()} == {a: "reachable", b: "corrupt"}


def test_tree(spark, tmp_path):
    for name, text in (("a.py", "x\ny\n"), ("b/c.rs", "fn"), ("node_modules/d.js", "no"), ("e.txt", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r["path"], r["language"], r["lines"]) for r in objects.file_tree(spark, str(tmp_path)).collect()}
    assert got == {("a.py", "python", 3), ("b/c.rs", "rust", 1)}


def test_export_and_restore(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    path = str(tmp_path / "out")
    objects.export({"t": df}, path)
    assert objects.restore(spark, path)["t"].count() == 2
    df.limit(1).write.mode("append").parquet(f"{path}/t")
    with pytest.raises(ValueError):
        objects.restore(spark, path)
    objects.put_projection(df, str(tmp_path), "p")
    assert objects.get_projection(spark, str(tmp_path), "p").count() == 2


def test_search_and_segments(spark, tmp_path):
    texts = spark.createDataFrame([("t", "a", 1, "red apple tree"), ("t", "b", 2, "blue sea"), ("t", "c", 3, "apple pie")], "kind string, id string, source_cursor long, text string")
    e = context.embedded(texts, 64)
    assert [r["id"] for r in context.text_search(e, "Apple tree red", 64, 2).collect()] == ["a", "c"]
    assert {r["id"] for r in context.stale(e, texts.withColumn("text", F.when(F.col("id") == "b", "new").otherwise(F.col("text"))).where("id <> 'c'")).collect()} == {"b", "c"}
    assert e.select(vector.unit_norm(F.col("dense"))).distinct().collect() == [(True,)]
    v = e.select(F.lit("m").alias("scope"), "source_cursor", "kind", "id", F.lit("f").alias("field"), F.lit(0).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), "dense")
    held, stamp = context.segment(v, str(tmp_path / "s"), scope="m", cursor=2, t=5)
    assert stamp["n"] == 2 and {r["id"] for r in held.collect()} == {"a", "b"}
