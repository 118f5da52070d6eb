"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed features: each token between white space, each two tokens in a
row (word bigrams; for a token that follows itself also one feature common to all of these), and the character n-grams
of a token with a begin and an end mark. A softmax over two classes reads that average; vectors and output weights are trained together by stochastic gradient
descent in numpy, one document a step.

As the output is linear in the average, a trained model is kept as one number a feature (its part of the log odds)
and a bias, so scoring a document is a mean of table entries. Scoring covers every whole text; training uses at most
``sample`` labelled documents of each class, chosen by a hash of their id (a parameter, so a run is repeatable).

Each text also gets PRIOR features of the labels' overall log odds, so that a text of a word or two, which says little,
is scored near the share of label 1.

Defined results: a null text counts as empty, and an empty text gets that share; rows without a
usable label are not trained on; several labels of a document count as the lowest; with labels of one class, or none,
every score is that class's smoothed share. doc_id may be null or repeated, and of any type that compares: each row gets
its own score. Of columns to keep that are called score or predicted, the operator's own take the place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh_worker, materialize, slices, small_batches, text_or_empty

BUCKETS, GRAMS, WIDTH, EPOCHS, RATE, SAMPLE = 1 << 18, (2, 4), 12, 12, 0.6, 1200
#: features at the prior that every text is given: what a word or two say is not much
PRIOR = 24


@dataclass
class Model:
    odds: np.ndarray  # of float32, by feature
    bias: float
    prior: float = 0.0  # the log odds of label 1 among all usable labels


def word_hash(token: str) -> int:
    return zlib.crc32(("w " + token).encode("utf-8", "replace"))


def features(token: str) -> list[int]:
    """The buckets of a token: itself, and its marked character n-grams."""
    marked, (short, long) = f"<{token}>", GRAMS
    grams = [marked[i : i + n] for n in range(short, long + 1) for i in range(len(marked) - n + 1)]
    return [word_hash(token) % BUCKETS, *[zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams]]


@cache
def _crc_parts(size: int) -> np.ndarray:
    """What each byte at each place adds to the CRC-32 of ``size`` bytes: that of zeros with all parts XORed to it, as
    the checksum of strings of one length is affine in their bits."""
    zero = zlib.crc32(bytes(size))
    return np.array([[zlib.crc32(bytes(k) + bytes([b]) + bytes(size - 1 - k)) ^ zero for b in range(256)] for k in range(size)], np.uint32)


def all_features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens' word hashes; and of what features() gives for each the buckets, and the tokens' places, in any order."""
    words = np.fromiter(map(word_hash, tokens), np.uint64, len(tokens))
    buckets, places = [(words % BUCKETS).astype(np.int64)], [np.arange(len(tokens))]
    data = np.frombuffer("".join([f"<{t}>" for t in tokens]).encode("utf-8", "replace"), np.uint8)
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of the characters
    chars = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 2
    place, left = np.repeat(places[0], chars), np.repeat(np.cumsum(chars), chars) - np.arange(len(starts) - 1)
    for n in range(GRAMS[0], GRAMS[1] + 1):
        at = np.flatnonzero(left >= n)
        begin, size = starts[at], starts[at + n] - starts[at]
        value = np.empty(len(at), np.uint32)
        for m in np.flatnonzero(np.bincount(size)):
            own = size == m
            here, found = begin[own], np.full(int(own.sum()), zlib.crc32(bytes(m)), np.uint32)
            for k, part in enumerate(_crc_parts(int(m))):
                found ^= part[data[here + k]]
            value[own] = found
        buckets.append((value % BUCKETS).astype(np.int64))
        places.append(place[at])
    return words, np.concatenate(buckets), np.concatenate(places)


#: the bucket of the bigrams whose second word is their first
AGAIN = zlib.crc32(b"2 =") % BUCKETS


def bigrams(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each two words in a row, of their hashes, and AGAIN for each word that follows itself; with the
    text of each. Words of different texts (``owner``) make no pair."""
    both = owner[1:] == owner[:-1]
    first, second, owner = hashes[:-1][both], hashes[1:][both], owner[1:][both]
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xD6E8FEB86659FD93)
    buckets, again = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), first == second
    return np.concatenate([buckets, np.full(int(again.sum()), AGAIN)]), np.concatenate([owner, owner[again]])


def _numbered(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The different words, and the place of each word among them."""
    places = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return list(places), np.fromiter(map(places.__getitem__, words), np.int64, len(words))


def _cut(texts: Iterable[str], most: int = 1 << 20) -> Iterator[tuple[list[str], np.ndarray]]:
    """The words of texts and the text of each, in groups of about ``most`` characters: what is held is bounded."""
    words, owner, size = [], [], 0
    for k, part in ((k, part) for k, text in enumerate(texts) for part in slices(text)):
        found = part.split()
        words += found
        owner.append((k, len(found)))
        size += len(part)
        if size >= most and words:
            yield words, np.repeat(*np.array(owner).T)
            words, owner, size = [], [], 0
    if words:
        yield words, np.repeat(*np.array(owner).T)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _featurized(docs: DataFrame) -> DataFrame:
    """label, place (of the row in an order that is the same in each run), and the counted features of each text, as the
    bytes of int32."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("label", pa.int32()), ("place", pa.int64()), ("bucket", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            buckets, times = [], []
            for text in batch.column(2).to_pylist():
                counts, before = np.zeros(BUCKETS, np.int64), np.zeros(0, np.uint64)
                for words, _ in _cut([text]):
                    tokens, place = _numbered(words)
                    hashes, bucket, token = all_features(tokens)
                    np.add.at(counts, bucket, np.bincount(place)[token])
                    row = np.concatenate([before, hashes[place]])
                    np.add.at(counts, bigrams(row, np.zeros(len(row), np.int64))[0], 1)
                    before = row[-1:]
                found = np.flatnonzero(counts).astype(np.int32)
                buckets.append(found.tobytes())
                times.append(counts[found].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, schema.field(2).type), pa.array(times, schema.field(3).type)], schema=schema)

    return docs.mapInArrow(run, "label int, place long, bucket binary, times binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents; ``usable`` (a condition on doc_id) says which labels may be looked at."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    known = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.where(usable if usable is not None else F.lit(True)).groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    known = materialize(spark, known, "labels")
    place = F.xxhash64("doc_id")
    picked = [r for c in (0, 1) for r in known.where(F.col("label") == c).orderBy(place, "doc_id").limit(sample).collect()]
    if not picked:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    # at most 2 * sample rows of two numbers
    ids = spark.createDataFrame([(r["doc_id"], r["label"]) for r in picked], f"doc_id {kind.simpleString()}, label int")
    texts = docs.select("doc_id", text_or_empty(docs).alias("text")).join(F.broadcast(ids), "doc_id")
    texts = texts.select("label", F.xxhash64("doc_id", "text").alias("place"), "text")
    rows = _featurized(texts).orderBy("place").limit(2 * sample).collect()
    model = fit([(np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["times"], np.int32), r["label"]) for r in rows])
    if model.odds.any():  # else there is one class, whose share is the bias
        share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
        model.prior = float(np.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1)))
    return model


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent over (features, times, label), with classes weighed alike."""
    by_class = [sum(r[2] == c for r in rows) for c in (0, 1)]
    if not all(by_class):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((by_class[1] + 1) / (by_class[0] + 1))))
    rng = np.random.default_rng(seed)
    vectors, out, bias = np.zeros((BUCKETS, WIDTH), np.float32), rng.normal(0, 0.3, (2, WIDTH)).astype(np.float32), np.zeros(2, np.float32)
    share = [len(rows) / (2 * n) for n in by_class]
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            bucket, times, label = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(bucket):
                continue
            weight = times / np.float32(times.sum())
            hidden = weight @ vectors[bucket]
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            p *= share[label] * rate
            back = out.T @ p
            out -= np.outer(p, hidden)
            bias -= p * 0.1
            # a step of the same length whether a text has ten features or a million
            vectors[bucket] -= np.outer(weight * (1 / max(float(weight @ weight), 1e-3)) ** 0.5, back)
    odds = vectors @ (out[1] - out[0])
    return Model(odds.astype(np.float32), float(bias[1] - bias[0]))


def score_of(text: Column, model: Model, docs: DataFrame) -> Column:
    """How likely, of 0 to 1, a text (not null) has label 1. Texts go to Python, once, and scores come back."""
    import pandas as pd

    spark = docs.sparkSession
    small_batches(spark)
    shared, bias, prior = spark.sparkContext.broadcast(model.odds), model.bias, model.prior  # 1 MB, whatever the corpus

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fresh_worker()
        odds = shared.value

        for texts in parts:
            total, n, before = np.zeros(len(texts)), np.zeros(len(texts)), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            for words, owner in _cut(texts):
                tokens, place = _numbered(words)
                hashes, bucket, token = all_features(tokens)
                sums, sizes = np.bincount(token, odds[bucket], len(tokens)), np.bincount(token, minlength=len(tokens))
                row, owners = np.concatenate([before[0], hashes[place]]), np.concatenate([before[1], owner])
                pairs, of = bigrams(row, owners)
                total += np.bincount(owner, sums[place], len(texts)) + np.bincount(of, odds[pairs], len(texts))
                n += np.bincount(owner, sizes[place], len(texts)) + np.bincount(of, minlength=len(texts))
                before = row[-1:], owners[-1:]
            z = bias + (total + PRIOR * prior) / (n + PRIOR)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))), dtype="float64")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}  # annotations are text in this module
    return F.pandas_udf(run, "double")(text)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with score: how likely, of 0 to 1, the text has label 1."""
    return docs.select(*[docs[c] for c in keep if c != "score"], score_of(text_or_empty(docs), model, docs).alias("score"))


def _fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs, labels, usable=~held_out(F.col("doc_id")))


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: float = 0.7) -> DataFrame:
    """Train on labels outside the held-out fold and score every row of docs."""
    scored = score(docs, _fitted(docs, labels), tuple(c for c in keep if c != "predicted"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that classify() gives predicted = 1."""
    return docs.where(score_of(text_or_empty(docs), _fitted(docs, labels), docs) >= least)
