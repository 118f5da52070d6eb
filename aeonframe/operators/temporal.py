"""Bitemporal operators over claims: resolution as of an instant, history, corrections, projections and recall.

Claims have subject, predicate, object, valid_from, valid_to (null: open), tx_time, seq and actor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["subject", "predicate"]


def in_window(t, start: str = "valid_from", end: str = "valid_to") -> Column:
    t = t if isinstance(t, Column) else F.lit(t)
    return (F.col(start) <= t) & (F.col(end).isNull() | (t < F.col(end)))


def _newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the greatest by ``order``: a hash aggregate with a partial step, no sort of the groups."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"b.{c}").alias(c) for c in df.columns])


def as_of(claims: DataFrame, t: int) -> DataFrame:
    """For each pair: the newest correction of each start, then the newest start whose window holds t.

    A correction that ended before t lets an older start show through; a superseded correction never does.
    """
    corrected = _newest(claims.where(F.col("valid_from") <= t), [*PAIR, "valid_from"], ["tx_time", "seq"])
    return _newest(corrected.where(in_window(t)), PAIR, ["valid_from"])


def history(claims: DataFrame, subject: str, predicate: str | None = None) -> DataFrame:
    """All versions, newest first."""
    own = claims.where(F.col("subject") == subject)
    own = own.where(F.col("predicate") == predicate) if predicate is not None else own
    return own.orderBy("predicate", F.desc("valid_from"), F.desc("tx_time"), F.desc("seq"))


def changed_since(claims: DataFrame, since: int) -> DataFrame:
    """What was recorded after an instant, however far back it is valid."""
    return claims.where(F.col("tx_time") > since)


def sequence_range(claims: DataFrame, after: int, through: int) -> DataFrame:
    """Append order, the lower end exclusive and the upper inclusive."""
    return claims.where((F.col("seq") > after) & (F.col("seq") <= through)).orderBy("seq")


def differential(claims: DataFrame, after: int, through: int) -> DataFrame:
    """The claims between two watermarks, with a digest of each."""
    body = F.concat_ws("|", "subject", "predicate", "object", F.col("valid_from").cast("string"), F.coalesce(F.col("valid_to").cast("string"), F.lit("open")))
    return sequence_range(claims, after, through).withColumn("digest", F.sha2(body, 256))


def subjects(claims: DataFrame) -> DataFrame:
    return claims.select("subject").distinct().orderBy("subject")


def supersede_pairs(current: DataFrame, successors: DataFrame) -> DataFrame:
    """A successor (subject, predicate, object, at) in place of what is in force: a retirement that closes the window of
    the standing claim, and the new claim; where nothing stands, the new claim alone."""
    now = current.select(*PAIR, F.col("object").alias("old"), F.col("valid_from").alias("old_from"))
    joined = successors.join(now, PAIR, "left")
    new = F.struct(F.lit("assert").alias("step"), F.col("object").alias("object"), F.col("at").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.col("at").alias("tx_time"))
    gone = F.struct(F.lit("retire").alias("step"), F.col("old").alias("object"), F.col("old_from").alias("valid_from"), F.col("at").alias("valid_to"), F.col("at").alias("tx_time"))
    legal = F.col("old_from") < F.col("at")
    rows = F.when(F.col("old_from").isNull(), F.array(new)).when(legal, F.array(gone, new)).otherwise(F.array().cast("array<struct<step:string,object:string,valid_from:bigint,valid_to:bigint,tx_time:bigint>>"))
    return joined.select(*PAIR, F.inline(rows))


def current_projection(claims: DataFrame) -> DataFrame:
    """The newest recorded version of each pair, in force or not."""
    return _newest(claims, PAIR, ["valid_from", "tx_time", "seq"])


def fold(projection: DataFrame, claims: DataFrame, watermark: int) -> DataFrame:
    """The projection after the claims behind the watermark; folding what it has already is harmless."""
    return current_projection(projection.unionByName(claims.where(F.col("seq") > watermark)))


def grounding(projection: DataFrame, recomputed: DataFrame) -> DataFrame:
    """What differs: missing (only recomputed), extra (only projected), or changed pairs. Empty means grounded."""
    value = F.struct("object", "valid_from", "valid_to", "tx_time")
    a, b = projection.select(*PAIR, value.alias("have")), recomputed.select(*PAIR, value.alias("want"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").otherwise("changed")
    return a.join(b, PAIR, "full_outer").where(~F.col("have").eqNullSafe(F.col("want"))).select(*PAIR, state.alias("state"))


class Projection:
    """A projection that refuses to be read once grounding has found it wrong."""

    def __init__(self, rows: DataFrame, watermark: int):
        self.rows, self.watermark, self.quarantined = rows, watermark, False

    def read(self) -> DataFrame:
        if self.quarantined:
            raise RuntimeError("the projection is quarantined; reset it")
        return self.rows

    def advance(self, claims: DataFrame, through: int) -> None:
        if through > self.watermark:
            self.rows, self.watermark = fold(self.read(), claims.where(F.col("seq") <= through), self.watermark), through

    def ground(self, claims: DataFrame) -> DataFrame:
        found = grounding(self.rows, current_projection(claims.where(F.col("seq") <= self.watermark)))
        self.quarantined = not found.isEmpty()
        return found

    def reset(self, claims: DataFrame) -> None:
        self.rows, self.watermark, self.quarantined = current_projection(claims.limit(0)), -1, False


def token_cost(*parts: str) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(sum(F.octet_length(p) for p in parts) / 4).cast("long")


def budget_fill(rows: DataFrame, group: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Take rows in order while they fit; one that doesn't is passed over, the first is always taken.

    What fits depends on what was taken, so it is a fold over the ordered costs of a group. Rows are folded as arrays
    of order key and cost alone and joined back.
    """
    keys = F.struct(*order, cost)
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("at"))

    def step(s, x):
        fits = (s["at"] == 0) | (s["spent"] + x[cost] <= budget)
        taken = F.when(fits, F.concat(s["taken"], F.array(s["at"]))).otherwise(s["taken"])
        return F.struct((s["spent"] + F.when(fits, x[cost]).otherwise(F.lit(0))).cast("long").alias("spent"), taken.alias("taken"), (s["at"] + 1).alias("at"))

    folded = rows.groupBy(*group).agg(F.array_sort(F.collect_list(keys)).alias("all")).withColumn("end", F.aggregate("all", start, step))
    chosen = folded.select(*group, F.size("all").alias("offered"), F.size("end.taken").alias("n_taken"), F.col("end.spent").alias("spent"), F.explode(F.transform("end.taken", lambda i: F.get("all", i))).alias("x"))
    return chosen.select(*group, *[F.col(f"x.{c}").alias(c) for c in (*order, cost)], "spent", (F.col("n_taken") < F.col("offered")).alias("truncated"))


def recall(claims: DataFrame, wanted: DataFrame, t: int, budget: int, predicates: list[str] | None = None) -> DataFrame:
    """wanted (query, place, subject): the claims in force of each query's subjects, in their order, within its budget."""
    own = claims.where(F.col("predicate").isin(predicates)) if predicates else claims
    asked = wanted.groupBy("query", "subject").agg(F.min("place").alias("place"))
    found = as_of(own.join(asked.select("subject").distinct(), "subject", "left_semi"), t).join(asked, "subject")
    found = found.withColumn("tokens", token_cost("subject", "predicate", "object", "actor"))
    return budget_fill(found, ["query"], ["place", "subject", "predicate", "object"], "tokens", budget)


def subject_match(prompts: DataFrame, known: DataFrame) -> DataFrame:
    """prompts (prompt, text), known (subject): the subjects that a prompt names as a word (letters and digits of any
    script, - and _), case aside."""
    words = prompts.select("prompt", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{IsAlphabetic}\p{N}_-]+"))).alias("word")).where("word <> ''")
    return words.join(known.select("subject", F.lower("subject").alias("word")).distinct(), "word").select("prompt", "subject").distinct()


def verification_state(claims: DataFrame, now: int) -> DataFrame:
    """Each pair: current (in force now), expired with the days since its last window closed, or never (none has)."""
    live = as_of(claims, now).select(*PAIR, F.lit(True).alias("live"))
    ended = claims.groupBy(*PAIR).agg(F.max("valid_to").alias("until"))
    state = F.when(F.col("live"), "current").when(F.col("until") <= now, "expired").otherwise("never")
    return ended.join(live, PAIR, "left").select(*PAIR, state.alias("state"), F.when(state == "expired", F.floor((F.lit(now) - F.col("until")) / 86_400_000)).cast("long").alias("days"))


def removal_report(claims: DataFrame, access: DataFrame, since: int, at: int) -> DataFrame:
    """Each pair of a claim with its accesses in [since, at]; none makes it a candidate for removal."""
    held = claims.groupBy(*PAIR).agg(F.count("*").alias("versions"))
    read = access.where(F.col("at").between(since, at)).groupBy(*PAIR).agg(F.count("*").alias("accesses"), F.max(F.struct("at", "reader")).alias("m"))
    out = held.join(read, PAIR, "left")
    return out.select(*PAIR, "versions", F.coalesce("accesses", F.lit(0)).alias("accesses"), F.col("m.at").alias("last_at"), F.col("m.reader").alias("last_reader"), F.col("m").isNull().alias("candidate"))


def version_at(rows: DataFrame, keys: list[str], sequence: int, seq: str = "seq", value: str = "value") -> DataFrame:
    """Key-value reads at a snapshot: the newest version up to a sequence; a null value is a tombstone and hidden."""
    best = rows.where(F.col(seq) <= sequence).groupBy(*keys).agg(F.max_by(F.struct(value), F.col(seq)).alias("b"))
    return best.select(*keys, F.col(f"b.{value}").alias(value)).where(F.col(value).isNotNull())


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "DataFrame", "F")]
