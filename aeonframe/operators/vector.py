"""Vector search: visibility, exact scores, top k, quantization, feature hashing and a sampled index.

vectors: scope, source_cursor, kind, id, field, valid_from, valid_to, properties and a value (dense: array<float>).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import Filter
from .temporal import in_window

METRICS = ("cosine", "dot", "l2", "l1")


def visible(vectors: DataFrame, scope: str, cursor: int, t: int, field: str | None = None, where: Filter | None = None) -> DataFrame:
    """What a search may see. Scope, cursor and start come before the choice of each identity's latest version; field,
    end of validity and payload come after it, lest they bring back a version that was superseded."""
    known = vectors.where((F.col("scope") == scope) & (F.col("source_cursor") <= cursor) & (F.col("valid_from") <= t))
    keys = ["kind", "id"]
    rest = [c for c in vectors.columns if c not in keys]
    best = known.groupBy(*keys).agg(F.max_by(F.struct(*rest), "source_cursor").alias("b"))
    out = best.select(*[F.col(c) if c in keys else F.col(f"b.{c}").alias(c) for c in vectors.columns]).where(in_window(t))
    out = out.where(F.col("field") == field) if field is not None else out
    return out.where(where.validate().column()) if where is not None else out


def duplicates(vectors: DataFrame) -> DataFrame:
    """Versions that share identity and cursor: a search over them is refused."""
    return vectors.groupBy("kind", "id", "source_cursor").count().where("count > 1")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def score(value: Column, query: list[float], metric: str = "cosine") -> Column:
    """Sums in double, left to right; higher is better; a zero vector has cosine 0; another length is an error."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    v, q = value.cast("array<double>"), F.array(*[F.lit(float(x)) for x in query])
    if metric == "dot":
        out = _dot(v, q)
    elif metric == "cosine":
        norms = F.sqrt(_dot(v, v)) * math.sqrt(sum(x * x for x in map(float, query)))
        out = F.when(norms == 0, 0.0).otherwise(_dot(v, q) / norms)
    elif metric == "l2":
        out = -F.sqrt(F.aggregate(F.zip_with(v, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    else:
        out = -F.aggregate(F.zip_with(v, q, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(value) == len(query), out).otherwise(F.raise_error(F.lit("dimensions differ")).cast("double"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """By score, then kind and id, then the newest cursor: a partial top k in each task, then one of what is left."""
    if not 1 <= k <= 100_000:
        raise ValueError("k is 1 to 100000")
    return scored.orderBy(F.desc("score"), "kind", "id", F.desc("source_cursor")).limit(k)


def search(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", **sight) -> DataFrame:
    found = visible(vectors, **sight).withColumn("score", score(F.col("dense"), query, metric))
    return top_k(found, k).select("kind", "id", "source_cursor", "score")


def score_many(vectors: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """Cosine top k of many queries: Arrow batches and one matrix product each; every task keeps k a query."""
    q = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in q]
        for batch in batches:
            kinds, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            value = np.stack(batch.column(2).to_numpy(zero_copy_only=False)).astype(np.float64)
            norm = np.linalg.norm(value, axis=1)
            s = (value @ q.T) / np.where(norm == 0, 1, norm)[:, None]
            for j in range(len(q)):
                own = s[:, j]
                top = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else range(len(own))  # ties too
                best[j] = sorted([*best[j], *[(-s[i, j], kinds[i], ids[i]) for i in top]])[:k]
        rows = [(j, kind, i, -x) for j, own in enumerate(best) for x, kind, i in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["query", "kind", "id", "score"])

    part = vectors.select("kind", "id", "dense").mapInArrow(run, "query long, kind string, id string, score double")
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "kind", "id"))  # k rows a task
    return part.withColumn("place", rank).where(F.col("place") <= k)


# -- sparse and multiple vectors ----------------------------------------------------------------------------
def sparse_score(value: Column, query: dict[int, float], metric: str = "dot") -> Column:
    """value: struct(indices, values). Distances count the coordinates that only one side has."""
    own = F.map_from_arrays(value["indices"], value["values"].cast("array<double>"))
    other = F.create_map(*[x for i, v in sorted(query.items()) for x in (F.lit(i), F.lit(float(v)))])
    zero = F.lit(0.0)
    both = F.map_values(F.map_zip_with(own, other, lambda _, a, b: F.struct(F.coalesce(a, zero).alias("a"), F.coalesce(b, zero).alias("b"))))
    total = lambda f: F.aggregate(both, zero, lambda s, x: s + f(x["a"], x["b"]))
    dot = total(lambda a, b: a * b)
    if metric == "dot":
        return dot
    if metric == "cosine":
        norms = F.sqrt(total(lambda a, b: a * a)) * math.sqrt(sum(v * v for v in query.values()))
        return F.when(norms == 0, 0.0).otherwise(dot / norms)
    if metric == "l2":
        return -F.sqrt(total(lambda a, b: (a - b) * (a - b)))
    if metric == "l1":
        return -total(lambda a, b: F.abs(a - b))
    raise ValueError(f"unknown metric {metric}")


def max_sim(rows: Column, query: list[list[float]], metric: str = "dot") -> Column:
    """The sum over the query's rows of their best score, by any metric, with a row of the candidate."""
    def best(q: list[float]) -> Column:
        return F.array_max(F.transform(rows, lambda r: score(r, q, metric)))

    parts = [best(q) for q in query]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def valid_dense(value: Column, dimensions: int) -> Column:
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(value) == dimensions) & finite, F.lit(False))


def valid_sparse(value: Column) -> Column:
    """Indices ascend without repeats and lie below the dimensions; there is a finite value for each."""
    i = value["indices"]
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(i), F.lit(1))), lambda k: (k >= F.size(i)) | (F.get(i, k - 1) < F.get(i, k)))
    inside = F.forall(i, lambda x: (x >= 0) & (x < value["dimensions"]))
    finite = F.forall(value["values"], lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(i) == F.size(value["values"])) & rising & inside & finite, F.lit(False))


def unit_norm(value: Column, tolerance: float = 1e-4) -> Column:
    v = value.cast("array<double>")
    return F.abs(_dot(v, v) - 1) <= tolerance


# -- int8 ---------------------------------------------------------------------------------------------------
def quantized(value: Column) -> Column:
    """struct(scale, codes): symmetric, the largest magnitude at 127; ties away from zero."""
    v = value.cast("array<double>")
    scale = F.array_max(F.transform(v, F.abs)) / 127
    codes = F.transform(v, lambda x: F.when(scale == 0, 0).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / scale)))).cast("int"))
    return F.struct(scale.alias("scale"), codes.alias("codes"))


def decoded(code: Column) -> Column:
    return F.transform(code["codes"], lambda c: c * code["scale"])


# -- feature hashing ----------------------------------------------------------------------------------------
def feature_tokens(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def feature_hash(text: Column, dimensions: int, prefix: bytes = b"aeon-feature-hash", seed: int = 0) -> Column:
    """Distinct tokens, each at a place and with a sign from its SHA-256, summed and brought to unit length. Time is linear
    in the tokens, whatever the dimensions; a text without tokens gives zeros, a null null."""
    import pandas as pd

    head = prefix + seed.to_bytes(8, "big")

    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for tokens in texts:
            if tokens is None:
                out.append(None)
                continue
            v = np.zeros(dimensions)
            for w in tokens:
                h = hashlib.sha256(head + w.encode()).digest()
                v[int.from_bytes(h[:8], "big") % dimensions] += 1.0 if h[8] & 1 == 0 else -1.0
            size = np.sqrt(v @ v)
            out.append(v / size if size else v)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}  # annotations are text in this module
    return F.pandas_udf(run, "array<double>")(feature_tokens(text))


# -- approximate search -------------------------------------------------------------------------------------
class Partitions:
    """An inverted file: rows are assigned to the nearest of a few centroids, which are fitted on a bounded sample
    (``sample`` rows by hash of id); every row is indexed. A search scans the ``probes`` nearest lists and ranks what is
    there exactly, so its scores are those of the exact scan, and filters apply before the ranking."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    @classmethod
    def fit(cls, vectors: DataFrame, lists: int = 16, sample: int = 20_000, rounds: int = 12, seed: int = 3) -> Partitions:
        rows = vectors.select("id", "dense").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        x = np.array([r["dense"] for r in rows], np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        c = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds):
            near = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
        return cls(c)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """vectors with list, the number of the nearest centroid (JVM only: the lists are few)."""
        v = F.col("dense").cast("array<double>")
        sims = F.array(*[_dot(v, F.array(*map(F.lit, map(float, c)))) for c in self.centroids])
        return vectors.withColumn("list", F.array_position(sims, F.array_max(sims)).cast("int") - 1)

    def search(self, indexed: DataFrame, query: list[float], k: int, probes: int, metric: str = "cosine") -> DataFrame:
        q = np.array(query) / max(np.linalg.norm(query), 1e-30)
        chosen = np.argsort(-(self.centroids @ q))[:probes].tolist()
        scanned = indexed.where(F.col("list").isin(chosen))
        return top_k(scanned.withColumn("score", score(F.col("dense"), query, metric)), k).select("kind", "id", "source_cursor", "score")
