"""Benchmark decontamination by SimHash of item-sized windows.

Each benchmark item, and each window of a document that is as long as an item, gets a SimHash over its word shingles.
Fingerprints are compared by multi-index Hamming blocks: 64 bits are cut in four blocks, and two fingerprints within
``4 * NEAR + 3`` bits have a block within NEAR bits, so an equi-join of the windows' blocks with all values within NEAR
bits of the items' blocks finds every pair within the radius. What it finds is verified by the exact weighted
(multiset) Jaccard similarity of the shingles.

A window that shares no shingle with an item has similarity zero, so windows are laid only where a document has an
item's shingle: begin and length follow from the shingle's place in the item, cut at the ends of the document. Only
texts whose hash falls in the slot of a text with a window are shuffled to join their windows; the join itself is exact.

The main path is DataFrame functions only. Tables made of the items are broadcast only if the items are at most
BROADCAST; else they are ordinary joins.

Defined results: words are runs of letters and digits, in lower case; items and documents that are null or without
words match nothing; an item of fewer than five words has one shingle of all its words; repeated rows are repeated in
no way: a result row is a distinct (doc_id, text, item_id); of windows that tie the first counts. Further columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

SHINGLE, LEAST, NEAR, BROADCAST = 5, 0.8, 3, 1000
#: slots of texts' hashes, by which most texts without a window are left out before the join with the windows
SLOTS = 1 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(of: Column, k: int) -> Column:
    """The hash of each of the k-word shingles, in order."""
    places = F.when(F.size(of) >= k, F.sequence(F.lit(0), F.size(of) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(of, i + j) for j in range(k)]))


def simhash(hashes: Column) -> Column:
    """A bit is set if more than half of the hashes, repeats included, have it."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, F.lit(b)).cast("int"))
    out = F.lit(0).cast("long")
    for b in range(64):
        out = out.bitwiseOR(F.when(ones(b) * 2 > F.size(hashes), F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard: each shingle weighs as often as it stands in the text."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF).cast("int")


def contamination(docs: DataFrame, items: DataFrame, least: float = LEAST, shingle: int = SHINGLE, keep_key: bool = False) -> DataFrame:
    """docs (doc_id, text), items (item_id, text): doc_id, item_id, start_word, end_word, distance and similarity."""
    spark = docs.sparkSession
    known = items.select("item_id", words(items["text"]).alias("w")).where(F.size("w") > 0).distinct()
    known = known.withColumn("k", F.least(F.size("w"), F.lit(shingle)))
    sizes = sorted(r["k"] for r in known.select("k").distinct().collect())  # at most five numbers
    few = known.limit(BROADCAST + 1).count() <= BROADCAST
    hint = F.broadcast if few else (lambda x: x)
    parts = [known.where(F.col("k") == k).select("item_id", "k", F.size("w").alias("size"), _shingles(F.col("w"), k).alias("item")) for k in sizes]
    if not parts:
        parts = [known.select("item_id", "k", F.size("w").alias("size"), F.array().cast("array<long>").alias("item"))]
    profile = parts[0]
    for p in parts[1:]:
        profile = profile.union(p)
    profile = materialize(spark, profile.withColumn("item_fp", simhash(F.col("item"))), "items")

    # where documents have an item's shingle, and the windows laid there
    anchors = profile.select("k", "size", F.posexplode("item").alias("q", "h")).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), words(text).alias("w"))
    windows = None
    for k in sizes or [shingle]:
        placed = rows.select("doc_id", "key", F.size("w").alias("n"), F.posexplode(_shingles(F.col("w"), k)).alias("p", "h"))
        begin, end = F.greatest(F.col("p") - F.col("q"), F.lit(0)), F.least(F.col("p") - F.col("q") + F.col("size"), F.col("n"))
        found = placed.join(hint(anchors.where(F.col("k") == k)), "h").select("doc_id", "key", F.lit(k).alias("k"), begin.alias("begin"), end.alias("end"))
        windows = found if windows is None else windows.union(found)
    laid = windows.distinct().groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_list(F.struct("k", "begin", "end")).alias("laid"))
    laid = materialize(spark, laid, "laid")
    slot = lambda key: F.pmod(key, F.lit(SLOTS)).cast("int")
    slots = laid.select(slot(F.col("__key")).alias("slot")).distinct()  # at most SLOTS numbers
    own = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    own = own.join(F.broadcast(slots), slot(F.col("key")) == F.col("slot"), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    # one row for rows that are alike, and only the windows' words go on
    lit = own.join(laid, same).select("doc_id", "key", "laid", words(F.col("text")).alias("w"))
    cut = lit.select("doc_id", "key", F.inline(F.transform("laid", lambda x: F.struct(x["k"].alias("k"), x["begin"].alias("begin"), x["end"].alias("end"), F.slice("w", x["begin"] + 1, x["end"] - x["begin"]).alias("words")))))
    hashed = F.lit(None).cast("array<long>")
    for k in sizes or [shingle]:
        hashed = F.when(F.col("k") == k, _shingles(F.col("words"), k)).otherwise(hashed)
    shaped = cut.select("doc_id", "key", "k", "begin", "end", hashed.alias("own")).where(F.size("own") > 0).withColumn("fp", simhash(F.col("own")))
    shaped = materialize(spark, shaped, "windows")

    # multi-index Hamming blocks
    near = F.array(*[F.lit(sum(1 << b for b in c)) for n in range(NEAR + 1) for c in combinations(range(16), n)])
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("item_fp"), b).alias("value")) for b in range(4)])
    index = profile.select("item_id", "k", F.inline(blocks)).select("item_id", "k", "block", "value", F.explode(near).alias("flip"))
    index = index.select("item_id", F.col("k").alias("item_k"), "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    mine = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(4)])
    probes = shaped.select("doc_id", "key", "k", "begin", "end", "own", "fp", F.inline(mine))
    met = probes.join(hint(index), ["block", "value"]).where("k = item_k").drop("block", "value", "item_k")
    pairs = met.join(hint(profile.select("item_id", "item", "item_fp")), "item_id")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    close = pairs.withColumn("distance", distance).where(F.col("distance") <= 4 * NEAR + 3)
    # a candidate is met in up to four blocks; the group below makes one of it
    scored = close.withColumn("similarity", similarity(F.col("own"), F.col("item"))).where(F.col("similarity") >= least)
    best = F.max_by(F.struct("begin", "end", "distance", "similarity"), F.struct("similarity", -F.col("begin"))).alias("b")
    out = scored.groupBy("doc_id", "key", "item_id").agg(best)
    ids = ["doc_id", "key"] if keep_key else ["doc_id"]
    return out.select(*ids, "item_id", F.col("b.begin").alias("start_word"), F.col("b.end").alias("end_word"), F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    hit = contamination(docs, items, least, keep_key=True).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_anti")
