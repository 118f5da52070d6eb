"""Constraint checks over sets of versions with windows [valid_from, valid_to)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOREVER = (1 << 63) - 1


def dangling(refs: DataFrame, known: DataFrame) -> DataFrame:
    """refs (kind, id, ...) whose identity no record has."""
    return refs.join(known.select("kind", "id").distinct(), ["kind", "id"], "left_anti")


def unique_overlaps(rows: DataFrame, group: list[str], identity: list[str]) -> DataFrame:
    """rows with an equal value (``group``) and an overlapping window as another identity's: each row that one of the
    rows before it, in the order of starts, still overlaps.

    Sorted passes find them, not pairs: the latest end before a row belongs to its leader. If the leader is another
    identity, that end decides; if it is the row's own, the latest end of the others does, which is the greatest of
    the ends that led before each change of leader and of those that never led.
    """
    order = W.partitionBy(*group).orderBy("valid_from", *identity)
    before, through = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    end = F.struct(F.coalesce("valid_to", F.lit(FOREVER)).alias("end"), F.concat_ws("\u0001", *identity).alias("who"))
    led = rows.withColumn("__own", end).withColumn("__led", F.max("__own").over(before)).withColumn("__leads", F.max("__own").over(through))
    change = ~F.col("__led.who").eqNullSafe(F.col("__leads.who"))
    beaten = F.when(change, F.col("__led.end")).when(F.col("__own.who") != F.col("__leads.who"), F.col("__own.end"))
    second = led.withColumn("__beaten", beaten).withColumn("__second", F.max("__beaten").over(before))
    other = F.when(F.col("__led.who") != F.col("__own.who"), F.col("__led.end")).otherwise(F.col("__second"))
    return second.where(other > F.col("valid_from")).select(*rows.columns)


def max_overlap(rows: DataFrame, group: list[str]) -> DataFrame:
    """How many windows of a group are open at once, at most. A window that ends as another begins doesn't meet it."""
    steps = F.array(F.struct(F.col("valid_from").alias("at"), F.lit(1).alias("d")), F.struct(F.col("valid_to").alias("at"), F.lit(-1).alias("d")))
    ends = rows.select(*group, F.inline(steps)).where("at is not null").groupBy(*group, "at", "d").agg(F.sum("d").alias("d_sum"))
    running = F.sum("d_sum").over(W.partitionBy(*group).orderBy("at", "d").rowsBetween(W.unboundedPreceding, 0))
    return ends.withColumn("open", running).groupBy(*group).agg(F.greatest(F.max("open"), F.lit(0)).alias("most"))


def cardinality_violations(edges: DataFrame, by: list[str], limit: int) -> DataFrame:
    return max_overlap(edges, by).where(F.col("most") > limit)


def snapshot_relation(a: DataFrame, b: DataFrame) -> str:
    """Cursor vectors (shard, cursor): equal, dominates, dominated or concurrent. Different shards are an error."""
    both = a.select("shard", F.col("cursor").alias("x")).join(b.select("shard", F.col("cursor").alias("y")), "shard", "full_outer")
    r = both.agg(F.bool_or(F.col("x").isNull() | F.col("y").isNull()).alias("apart"), F.bool_or(F.col("x") > F.col("y")).alias("more"), F.bool_or(F.col("x") < F.col("y")).alias("less")).first()
    if r["apart"]:
        raise ValueError("the vectors cover different shards")
    return {(False, False): "equal", (True, False): "dominates", (False, True): "dominated", (True, True): "concurrent"}[bool(r["more"]), bool(r["less"])]


def schema_at(registry: DataFrame, cursor: int) -> DataFrame:
    """The newest revision of each scope known at a cursor."""
    rest = [c for c in registry.columns if c != "scope"]
    return registry.where(F.col("cursor") <= cursor).groupBy("scope").agg(F.max_by(F.struct(*rest), "cursor").alias("b")).select("scope", "b.*")


def as_of_join(left: DataFrame, right: DataFrame, key: list[str], at: str, value: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it: both sides in one order, the right one's
    values carried forward. Right rows come before left rows at the same time."""
    r = right.select(*key, F.col(at), F.lit(0).alias("__side"), F.struct(*value).alias("__v"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"))
    lft = left.select(*key, F.col(at), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), F.struct(*left.columns).alias("__row"))
    order = W.partitionBy(*key).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    carried = r.unionByName(lft).withColumn("__last", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    return carried.select("__row.*", *[F.col(f"__last.{v}").alias(f"asof_{v}") for v in value])


def reachability(objects: DataFrame, references: DataFrame, present: DataFrame) -> DataFrame:
    """objects (sha256, length) by state: reachable, orphan, or corrupt (what is stored has another digest or length)."""
    stored = present.select(F.col("sha256"), F.col("found_sha256"), F.col("found_length"))
    used = references.select("sha256").distinct().withColumn("used", F.lit(True))
    both = objects.join(stored, "sha256", "left").join(used, "sha256", "left")
    bad = F.col("found_sha256").isNull() | (F.col("found_sha256") != F.col("sha256")) | (F.col("found_length") != F.col("length"))
    return both.select("sha256", F.when(bad, "corrupt").when(F.col("used"), "reachable").otherwise("orphan").alias("state"))


def quorum_violations(replicas: DataFrame, voters: int = 3, zones: int = 2, per_zone: int = 2) -> DataFrame:
    """replicas (shard, node, zone, and role if not all are voters): shards that break the placement policy, which asks
    for an odd number of voters (three or more), so many zones at least and so many voters of a zone at most."""
    if voters < 3 or voters % 2 == 0 or not 2 <= zones <= voters or per_zone < 1:
        raise ValueError("a policy has an odd number of three voters or more, 2 zones or more, and a positive number a zone")
    votes = F.col("role") == "voter" if "role" in replicas.columns else F.lit(True)
    # a shard without a voter is one of the shards, too
    by_zone = replicas.groupBy("shard", "zone").agg(F.count_if(votes).alias("here"))
    found = by_zone.groupBy("shard").agg(F.sum("here").alias("n"), F.count_if(F.col("here") > 0).alias("z"), F.max("here").alias("most"))
    twice = replicas.groupBy("shard").agg((F.count("*") > F.count_distinct("node")).alias("twice"))
    return found.join(twice, "shard").where((F.col("n") != voters) | (F.col("z") < zones) | (F.col("most") > per_zone) | F.col("twice")).drop("most")


def geo_valid(sw_lon: str, sw_lat: str, ne_lon: str, ne_lat: str):
    """Longitudes and latitudes in range, finite, and the box not inverted."""
    ok = F.lit(True)
    for name, most in ((sw_lon, 180), (ne_lon, 180), (sw_lat, 90), (ne_lat, 90)):
        ok = ok & ~F.isnan(name) & F.col(name).between(-most, most)
    return F.coalesce(ok & (F.col(sw_lon) <= F.col(ne_lon)) & (F.col(sw_lat) <= F.col(ne_lat)), F.lit(False))
