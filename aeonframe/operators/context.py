"""Compositions: text search, immutable segments, preflight, context arms and the topology view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import routing, temporal, vector
from .integrity import set_digest


def embedded(texts: DataFrame, dimensions: int, text: str = "text") -> DataFrame:
    """texts with dense (a feature-hash embedding) and provenance: the digest of the source and of the model's name."""
    model = f"feature-hash-{dimensions}"
    provenance = F.struct(F.sha2(text, 256).alias("source_digest"), F.lit(model).alias("model"), F.sha2(F.lit(model), 256).alias("model_digest"), F.lit(dimensions).alias("dimensions"), F.lit("unit").alias("normalization"))
    return texts.withColumn("dense", vector.feature_hash(F.col(text), dimensions)).withColumn("provenance", provenance)


def stale(embeddings: DataFrame, texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Embeddings whose text is gone or another one by now."""
    now = texts.select(key, F.sha2(text, 256).alias("now"))
    return embeddings.join(now, key, "left").where(F.col("now").isNull() | (F.col("now") != F.col("provenance.source_digest"))).drop("now")


def text_search(embeddings: DataFrame, query: str, dimensions: int, k: int) -> DataFrame:
    """Cosine top k of embedded texts (kind, id, source_cursor, dense) for a query text, embedded the same way."""
    spark = embeddings.sparkSession
    q = spark.range(1).select(vector.feature_hash(F.lit(query), dimensions).alias("q")).first()["q"]
    return vector.top_k(embeddings.withColumn("score", vector.score(F.col("dense"), list(q))), k).select("kind", "id", "source_cursor", "score")


def segment(vectors: DataFrame, path: str, **sight) -> tuple[DataFrame, dict]:
    """What a search may see at a cursor, written in canonical order, with a digest of the set: searches of the segment
    give what an exact search of the log gives."""
    seen = vector.visible(vectors, **sight)
    seen.sortWithinPartitions("kind", "id", "source_cursor").write.parquet(path)
    held = vectors.sparkSession.read.schema(seen.schema).parquet(path)
    return held, set_digest(held, ["kind", "id", "source_cursor"]).first().asDict()


def preflight(claims: DataFrame, files: DataFrame, now: int, budget: int) -> dict[str, DataFrame]:
    """Stacks of the tree, freshness of what is known, and a recall over all subjects."""
    wanted = claims.select("subject").distinct().select(F.lit(0).alias("query"), F.lit(0).alias("place"), "subject")
    fresh = temporal.verification_state(claims, now)
    return {
        "stacks": routing.stacks(files),
        "freshness": fresh.groupBy("state").agg(F.count("*").alias("n")),
        "warnings": fresh.where("state <> 'current'").select("subject", "predicate", "state", "days"),
        "recall": temporal.recall(claims, wanted, now, budget),
    }


def context_arms(claims: DataFrame, prompts: DataFrame, now: int, budget: int) -> DataFrame:
    """What each prompt would be given within a budget of tokens: fresh (nothing), pruned (the claims of the subjects that
    it names), or full (the preflight's recall, the same for all prompts, and then the pruned claims)."""
    named = temporal.subject_match(prompts, claims.select("subject"))
    place = F.crc32(F.col("subject").cast("binary"))
    asked = named.select(F.col("prompt").cast("string").alias("query"), place.alias("place"), "subject")
    every = claims.select("subject").distinct().select(F.lit("*").alias("query"), F.lit(0).cast("long").alias("place"), "subject")
    got = temporal.recall(claims, asked.union(every), now, budget).groupBy("query").agg(F.count("*").alias("claims"), F.max("spent").alias("tokens"))
    common = got.where("query = '*'").agg(F.coalesce(F.max("claims"), F.lit(0)).alias("c"), F.coalesce(F.max("tokens"), F.lit(0)).alias("t")).first()  # one row
    own = prompts.select(F.col("prompt").cast("string").alias("prompt")).join(got.where("query <> '*'").withColumnRenamed("query", "prompt"), "prompt", "left").na.fill(0, ["claims", "tokens"])
    arm = lambda name, c, t: own.select(F.lit(name).alias("arm"), "prompt", c.cast("long").alias("claims"), t.cast("long").alias("tokens"))
    return arm("fresh", F.lit(0), F.lit(0)).union(arm("pruned", F.col("claims"), F.col("tokens"))).union(arm("full", F.col("claims") + common["c"], F.col("tokens") + common["t"]))


def topology(claims: DataFrame, runs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (kind, id) and edges (kind, a, b) of claims in force, runs and files, in one view."""
    def nodes(df: DataFrame, kind: str, id_: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), id_.cast("string").alias("id")).distinct()

    points = nodes(claims, "subject", F.col("subject")).union(nodes(claims, "actor", F.col("actor"))).union(nodes(runs, "run", F.col("run_id"))).union(nodes(files, "file", F.col("path")))
    said = claims.select(F.lit("said").alias("kind"), F.col("actor").alias("a"), F.col("subject").alias("b"))
    kept = files.select(F.lit("in").alias("kind"), F.col("path").alias("a"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("b"))
    return points, said.union(kept).distinct()
