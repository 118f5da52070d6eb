"""Content-addressed objects, source trees, named blobs and table archives, on any file system that Spark reads."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED = (".git", "node_modules", "target", "dist", "__pycache__", ".venv")
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "py": "python", "svelte": "svelte"}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def object_path(root: str, sha256: str) -> str:
    return f"{root.rstrip('/')}/objects/sha256/{sha256[:2]}/{sha256}"


def put(spark: SparkSession, root: str, data: bytes) -> str:
    """Store bytes under their digest; what is there already stays. The file appears whole, by a rename."""
    name = hashlib.sha256(data).hexdigest()
    fs, path = _fs(spark, object_path(root, name))
    if not fs.exists(path):
        _, part = _fs(spark, object_path(root, name) + ".part")
        out = fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        fs.mkdirs(path.getParent())
        fs.rename(part, path)
    return name


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """sha256 (of the name), found_sha256 and found_length of every stored object."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/objects/sha256")
    return files.select(F.regexp_extract("path", r"([0-9a-f]{64})$", 1).alias("sha256"), F.sha2("content", 256).alias("found_sha256"), F.col("length").alias("found_length")).where("sha256 <> ''")


def get(spark: SparkSession, root: str, sha256: str) -> bytes:
    row = spark.read.format("binaryFile").load(object_path(root, sha256)).select("content").first()
    data = bytes(row["content"])
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{sha256} is stored with other bytes")
    return data


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), language, lines, digest and text of the source files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^.*?" + root.rstrip("/").removeprefix("file://").replace(".", r"\.") + "/", "")
    named = files.withColumn("rel", path).where(~F.arrays_overlap(F.split("rel", "/"), F.array(*map(F.lit, EXCLUDED))))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    language = F.element_at(table, F.regexp_extract("rel", r"\.([^./]+)$", 1))
    text = F.decode("content", "UTF-8")
    return named.withColumn("language", language).where("language is not null").select(F.col("rel").alias("path"), "language", F.size(F.split(text, "\n")).cast("long").alias("lines"), F.sha2("content", 256).alias("digest"), text.alias("text"))


def put_projection(df: DataFrame, root: str, name: str) -> None:
    """A named projection, replaced as a whole."""
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/projections/{name}")


def get_projection(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/projections/{name}")


def _checksum(df: DataFrame) -> list:
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(body).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(body)).alias("x")).first()
    return [r["n"], str(r["s"]), str(r["x"])]


def export(tables: dict[str, DataFrame], path: str) -> str:
    """Write tables and a manifest of their checksums; returns the manifest's digest."""
    spark = next(iter(tables.values())).sparkSession
    sums = {}
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{path}/{name}")
        sums[name] = _checksum(spark.read.parquet(f"{path}/{name}"))
    body = json.dumps(sums, sort_keys=True)
    spark.createDataFrame([(body, hashlib.sha256(body.encode()).hexdigest())], "body string, digest string").coalesce(1).write.json(f"{path}/manifest")
    return hashlib.sha256(body.encode()).hexdigest()


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an export, each held against the manifest."""
    row = spark.read.schema("body string, digest string").json(f"{path}/manifest").first()
    if hashlib.sha256(row["body"].encode()).hexdigest() != row["digest"]:
        raise ValueError("the manifest isn't the one that was written")
    out = {}
    for name, want in json.loads(row["body"]).items():
        out[name] = spark.read.parquet(f"{path}/{name}")
        if _checksum(out[name]) != want:
            raise ValueError(f"{name} differs from its checksum")
    return out
