"""Helpers that the operators of this subpackage share.

Nothing outside this subpackage imports this module.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; with texts of 100 KB a batch stays near 25 MB.
ROWS_PER_BATCH = 256

_BLANK_AFTER_SPACE = re.compile(r"\s ")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a fresh local one only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="aeonframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/aeonframe-{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it again: lineage ends at files that no executor owns."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by materialize()."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, whatever the length of a text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def text_or_empty(df: DataFrame, name: str = "text"):
    return F.coalesce(df[name].cast("string"), F.lit(""))


def constants(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A few rows of strings, numbers and booleans as a local relation (no Python on the executors)."""

    def literal(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "null" if x is None else str(x).lower()

    return spark.sql(f"select * from values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} as t({names})")


def rows_out(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def slices(text: str, size: int = 1 << 18) -> Iterator[str]:
    """Cut a long text before blanks that follow another character than white space."""
    begin = 0
    while len(text) - begin > size:
        cut = text.find(" ", begin + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:] if begin else text


_KEPT: dict = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """State of a Python worker for the tasks of one stage; what another stage left in the worker is dropped."""
    task = TaskContext.get()
    stage = (task.stageId(), task.getLocalProperty("spark.app.id")) if task else None
    if _KEPT.get("stage") != stage:
        _KEPT.clear()
        _KEPT["stage"] = stage
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def fresh_worker() -> None:
    """Drop what other stages left in this Python worker."""
    kept("", lambda: None)


@contextmanager
def no_cycles():
    """Work that makes many objects and no cycles, without the collector's passes over all that is held."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def groups(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """The texts in their order, in groups of about ``most`` characters: what is held at once is bounded."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield texts[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def gathered(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class PieceCache:
    """Results of a pure function of short strings, in two generations of bounded size.

    compute takes a list of strings and returns as many results (never None).
    """

    def __init__(self, compute: Callable[[list[str]], list], most: int = 200_000, longest: int = 64):
        self.compute, self.most, self.longest = compute, most, longest
        self.young: dict = {}
        self.old: dict = {}

    def get(self, pieces: list[str]) -> list:
        out = list(map(self.young.get, pieces))
        lacking = [i for i, v in enumerate(out) if v is None]
        if not lacking:
            return out
        found = dict.fromkeys([pieces[i] for i in lacking])
        if self.old:
            found.update(zip(found, list(map(self.old.get, found))))
        fresh = [k for k, v in found.items() if v is None]
        found.update(zip(fresh, self.compute(fresh)))
        for i in lacking:
            out[i] = found[pieces[i]]
        for k in [k for k in fresh if len(k) > self.longest]:
            del found[k]
        self.young.update(found)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return out


class WordPieces:
    """Map a text, piece by piece, through a function that respects the split of byte-level BPE.

    The split pattern never joins a character with white space that follows it, so a text may be cut
    before each blank that follows a character other than white space, and the parts be handled alone.
    """

    def __init__(self, compute: Callable[[list[str]], list], most: int = 300_000):
        self.cache = PieceCache(compute, most)

    def parts(self, text: str) -> list[str]:
        words = text.split(" ")
        parts = [words[0], *[" " + w for w in words[1:]]]
        if not parts[0]:
            del parts[0]
        return list(self._joined(parts)) if _BLANK_AFTER_SPACE.search(text) else parts

    @staticmethod
    def _joined(parts: list[str]) -> Iterator[str]:
        held = ""
        for p in parts:
            if held and not held[-1].isspace():
                yield held
                held = p
            else:
                held += p
        if held:
            yield held

    def get_all(self, texts: list[str]) -> Iterator[Iterator[list]]:
        """For each text the results of its pieces, slice by slice; what is new in short texts is computed together."""
        cut = [self.parts(t) if len(t) <= 1 << 18 else None for t in texts]
        found, at = self.cache.get([p for parts in cut if parts for p in parts]), 0
        for text, parts in zip(texts, cut):
            if parts is None:
                yield self.get(text)
            else:
                yield iter([found[at : at + len(parts)]])
                at += len(parts)

    def get(self, text: str) -> Iterator[list]:
        for part in slices(text):
            pieces = self.parts(part)
            if pieces:
                yield self.cache.get(pieces)
