"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within ``RADIUS`` differing bits are linked. Give each of the 64 bits one of the 2**(RADIUS+1) - 1
nonzero vectors of RADIUS + 1 bits; each such vector v is also a table, whose key keeps the bits with an odd inner
product with v. The vectors of RADIUS differing bits span less than the whole space, so some v is orthogonal to them
all: in its table the two keys are equal. No pair within the radius is ever missed, with 15 tables for a radius of 3.

Equal fingerprints are one node from the start, so copies never meet in a table. A bucket gives a spanning forest of
the links within it, never its pairs. A bucket of many distinct fingerprints is dealt out once more: the bits that its
key dropped are cut in blocks; two members agree on all but RADIUS of them, so keys of the other blocks (one for each
choice of RADIUS blocks) bring every linked pair together in groups that the dropped bits of RADIUS blocks bound.

Defined results: a null text counts as empty; texts without a word have fingerprint zero, which links like any other;
texts of one or two words have one shingle. Rows with a null doc_id get a fingerprint and the smallest non-null id
reachable, else null. Repeated rows are repeated. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, small_batches, text_or_empty
from .components import components

RADIUS, SHINGLE = 3, 3
#: members of a bucket compared directly, and members that one task takes at all
DIRECT, IN_TASK = 512, 1 << 17
#: blocks of the dropped bits in the second dealing
BLOCKS = 8


def masks(radius: int = RADIUS) -> list[int]:
    """The kept bits of each table."""
    size = (1 << (radius + 1)) - 1
    vector = [1 + bit % size for bit in range(64)]
    return [sum(((vector[bit] & v).bit_count() & 1) << bit for bit in range(64)) for v in range(1, size + 1)]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is set if more than half of the shingles' hashes have it."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    counts, n, step = np.zeros(64, np.int64), max(1, len(words) - shingle + 1), 1 << 14
    for at in range(0, n, step):
        some = words[at : at + step + shingle - 1]
        grams = [b" ".join(g) for g in zip(*(some[k:] for k in range(shingle)))] or [b" ".join(some)]
        hashed = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], ">u8")
        counts += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    narrow = docs.select(*keep, text_or_empty(docs).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*keep, "fp"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{kinds}fp long")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within the radius among distinct fingerprints (uint64)."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))

    def among(members: np.ndarray) -> None:
        own = fps[members]
        for k in range(len(members) - 1):
            for m in np.flatnonzero(np.bitwise_count(own[k + 1 :] ^ own[k]) <= radius):
                join(members[k], members[k + 1 + m])

    if len(fps) <= DIRECT:
        among(np.arange(len(fps)))
    else:  # any two within the radius agree on all but ``radius`` blocks
        for key in _finer_keys(fps, np.bitwise_or.reduce(fps ^ fps[0]), radius):
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    among(group)
    return out


def _blocks(free: int) -> list[int]:
    bits = [b for b in range(64) if free >> b & 1]
    cuts = np.array_split(np.array(bits, np.int64), BLOCKS)
    return [sum(1 << int(b) for b in cut) for cut in cuts]


def _finer_keys(fps: np.ndarray, free, radius: int) -> Iterator[np.ndarray]:
    blocks = _blocks(int(free))
    for dropped in combinations(range(BLOCKS), radius):
        yield fps & np.uint64(sum(blocks[k] for k in range(BLOCKS) if k not in dropped))


_LINKS = "a long, b long, held int"


def _linked(grouped: DataFrame, radius: int, most: int | None) -> DataFrame:
    """grouped (table, key, fp), each group whole and in a row: links, or (fp, table) as held where it has over most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(table: int, fps: np.ndarray):
            if len(fps) > 1:
                found = _forest(fps, radius)
                if found:
                    i = np.array(found)
                    yield pa.RecordBatch.from_arrays([pa.array(fps[i[:, 0]].view(np.int64)), pa.array(fps[i[:, 1]].view(np.int64)), pa.array(np.zeros(len(i), np.int32))], names=["a", "b", "held"])

        def pass_on(table: int, fps: np.ndarray):
            n = len(fps)
            return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, table + 1, np.int32))], names=["a", "b", "held"])

        before, parts, size, over = None, [], 0, False
        for batch in batches:
            table, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(table) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(key)]):
                if begin == end:
                    continue
                this = (int(table[begin]), int(key[begin]))
                if this != before:
                    if before is not None and size > 1:
                        if over:
                            yield pass_on(before[0], np.concatenate(parts))
                        else:
                            yield from of(before[0], np.concatenate(parts))
                    before, parts, size, over = this, [], 0, False
                parts.append(fps[begin:end])
                size += end - begin
                if most and size > most:  # too many for one task: its members go on to finer keys
                    over = True
                    yield pass_on(this[0], np.concatenate(parts))
                    parts = [parts[-1][:0]]
        if before is not None and size > 1:
            if over:
                yield pass_on(before[0], np.concatenate(parts))
            else:
                yield from of(before[0], np.concatenate(parts))

    return grouped.mapInArrow(run, _LINKS)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct (fp, each once): links (a, b) that connect whatever is connected within the radius."""
    spark, tables = distinct.sparkSession, masks(radius)
    spread = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in tables]))
    keyed = distinct.select("fp", spread.alias("table", "key")).select("table", "key", "fp")
    found = materialize(spark, _linked(keyed.repartition("table", "key").sortWithinPartitions("table", "key"), radius, IN_TASK), "links")
    out = found.where("held = 0").select("a", "b")
    if not found.where("held > 0").limit(1).count():
        return out
    finer = []
    for t, mask in enumerate(tables):
        blocks = _blocks(~mask & (1 << 64) - 1)
        for dropped in combinations(range(BLOCKS), radius):
            kept = mask | sum(blocks[k] for k in range(BLOCKS) if k not in dropped)
            finer.append((t, kept - (1 << 64) if kept >> 63 else kept))
    chosen = F.broadcast(spark.createDataFrame([(t + 1, k, m) for k, (t, m) in enumerate(finer)], "held int, finer int, kept long"))
    dealt = found.where("held > 0").select("held", F.col("a").alias("fp")).join(chosen, "held").select(F.col("finer").alias("table"), F.col("fp").bitwiseAND(F.col("kept")).alias("key"), "fp")
    return out.union(_linked(dealt.repartition("table", "key").sortWithinPartitions("table", "key"), radius, None).select("a", "b"))


def _classes(made: DataFrame, radius: int) -> DataFrame:
    """made (doc_id, tk, fp): fp and first, the least (null flag, doc_id, tk) reachable from it."""
    spark = made.sparkSession
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tk"))
    nodes = materialize(spark, made.groupBy("fp").agg(least.alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return materialize(spark, rooted.join(firsts, "root").select("fp", "first"), "classes")


def _made(docs: DataFrame, shingle: int) -> DataFrame:
    keyed = docs.select("doc_id", "text", F.xxhash64(text_or_empty(docs)).alias("tk"))
    return materialize(docs.sparkSession, fingerprints(keyed, shingle, ("doc_id", "tk")), "fingerprints")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included) of each row."""
    made = _made(docs, shingle)
    return made.join(_classes(made, radius), "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def representatives(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row, all columns, of each component: that with the smallest doc_id (of rows with the same, one of them)."""
    made = _made(docs, shingle)
    firsts = _classes(made, radius).select(F.col("first.doc_id").alias("__id"), F.col("first.tk").alias("__tk")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty(docs)) == F.col("__tk"))
    out = docs.join(firsts, same, "left_semi")
    if made.groupBy("doc_id", "tk").count().where("count > 1").limit(1).count():  # rows that are alike
        out = out.withColumn("__tk", F.xxhash64(text_or_empty(out))).dropDuplicates(["doc_id", "__tk"]).drop("__tk")
    return out


def hexed(fp) -> "Column":  # noqa: F821
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
