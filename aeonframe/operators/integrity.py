"""Hash chains, digests, state machines and trace checks."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENESIS = "0" * 64


# -- canonical bytes ----------------------------------------------------------------------------------------
def frame(value: object) -> bytes:
    """Length-prefixed, big-endian, tagged: no two different values have the same bytes."""
    if value is None:
        return b"\0"
    if isinstance(value, bool):
        return b"\1" + bytes([value])
    if isinstance(value, int):
        return b"\2" + struct.pack(">q", value)
    if isinstance(value, str):
        raw = value.encode()
        return b"\3" + struct.pack(">Q", len(raw)) + raw
    if isinstance(value, dict):
        return b"\4" + struct.pack(">Q", len(value)) + b"".join(frame(k) + frame(v) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return b"\5" + struct.pack(">Q", len(value)) + b"".join(map(frame, value))
    raise TypeError(f"no canonical bytes for {type(value)}")


def digest(*parts: object) -> str:
    return hashlib.sha256(b"".join(map(frame, parts))).hexdigest()


def fnv1a64(data: bytes) -> int:
    """Fixed values of FNV-1a: offset basis 14695981039346656037, prime 1099511628211."""
    out = 14695981039346656037
    for b in data:
        out = (out ^ b) * 1099511628211 & (1 << 64) - 1
    return out


def chain(bodies: Iterable[str], previous: str = GENESIS) -> list[tuple[str, str]]:
    """(previous digest, digest) of each body: a chain is made one after the other, by its one writer."""
    out = []
    for body in bodies:
        now = hashlib.sha256((previous + "|" + body).encode()).hexdigest()
        out.append((previous, now))
        previous = now
    return out


def chain_verify(log: DataFrame, partitions_by: str = "scope") -> DataFrame:
    """log (scope, cursor, body, previous_digest, digest): each row's gap, broken and forged flags, where any is set.

    A row needs no order beyond its neighbour, so it is joined with the row of the cursor before it: one long scope is
    spread like many short ones. gap: no row has the cursor before it, or several rows have its own; broken: its previous
    digest isn't that row's (whatever it is where there is none); forged: its digest isn't that of what it holds.
    """
    scope = partitions_by
    made = F.sha2(F.concat_ws("|", "previous_digest", "body"), 256)
    known = log.groupBy(scope, "cursor").agg(F.min("digest").alias("__own"), F.count("*").alias("__n"))
    before = known.select(scope, (F.col("cursor") + 1).alias("cursor"), F.col("__own").alias("__before"))
    both = log.join(known.select(scope, "cursor", "__n"), [scope, "cursor"]).join(before, [scope, "cursor"], "left")
    first = F.col("cursor") == 1
    flags = both.withColumn("gap", (~first & F.col("__before").isNull()) | (F.col("__n") > 1))
    flags = flags.withColumn("broken", ~F.col("previous_digest").eqNullSafe(F.when(first, F.lit(GENESIS)).otherwise(F.col("__before"))))
    return flags.withColumn("forged", F.col("digest") != made).where("gap or broken or forged").select(scope, "cursor", "gap", "broken", "forged")


def set_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of a set of rows, whatever their order: the sum and the exclusive or of the rows' hashes, and their count."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("mixed"))


# -- the reasoning state machine ----------------------------------------------------------------------------
#: fixed values: state and payload to the next state. Decisions, verifications and outcomes carry their own word; after
#: the colon of a state stands what the last verification said, which an outcome must agree with.
TRANSITIONS = {
    ("empty", "goal"): "needs_plan",
    ("needs_plan", "plan"): "needs_attempt",
    ("needs_attempt", "attempt"): "needs_observation",
    ("needs_observation", "observation"): "needs_decision",
    ("needs_decision", "decision:continue"): "needs_attempt",
    ("needs_decision", "decision:verify"): "needs_verification",
    ("needs_decision", "decision:stop"): "needs_verification",
    ("needs_verification", "verification:pass"): "needs_outcome",
    ("needs_verification", "verification:fail"): "needs_post_verification_decision",
    ("needs_post_verification_decision", "decision:continue"): "needs_attempt",
    ("needs_post_verification_decision", "decision:stop"): "needs_outcome:failed",
    ("needs_outcome", "outcome:succeeded"): "complete",
    ("needs_outcome", "outcome:failed"): "complete",
    ("needs_outcome", "outcome:blocked"): "complete",
    ("needs_outcome:failed", "outcome:failed"): "complete",
    ("needs_outcome:failed", "outcome:blocked"): "complete",
}


def run_states(steps: DataFrame, transitions: dict | None = None) -> DataFrame:
    """steps (run_id, ordinal, payload): each run's state after its steps in order, and where it first was illegal.

    A run is folded as an ordered array of its payload words, in the JVM.
    """
    table = transitions or TRANSITIONS
    rules = F.create_map(*[F.lit(x) for (s, p), to in table.items() for x in (f"{s}>{p}", to)])
    start = F.struct(F.lit("empty").alias("state"), F.lit(-1).cast("long").alias("bad"))

    def step(s, x):
        to = F.element_at(rules, F.concat(s["state"], F.lit(">"), x["payload"]))
        stuck = (s["bad"] >= 0) | to.isNull()
        return F.struct(F.when(stuck, s["state"]).otherwise(to).alias("state"), F.when(s["bad"] >= 0, s["bad"]).when(to.isNull(), x["ordinal"].cast("long")).otherwise(s["bad"]).alias("bad"))

    folded = steps.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "payload"))).alias("all")).withColumn("end", F.aggregate("all", start, step))
    return folded.select("run_id", F.size("all").cast("long").alias("n_steps"), F.split_part(F.col("end.state"), F.lit(":"), F.lit(1)).alias("state"), F.when(F.col("end.bad") >= 0, F.col("end.bad")).alias("illegal_at"))


def active_runs(states: DataFrame) -> DataFrame:
    return states.where(~F.col("state").isin("complete"))


def exclusive(states: DataFrame) -> bool:
    """Whether at most one run is not complete."""
    return active_runs(states).limit(2).count() <= 1


#: fixed values: tools that change a project, and the control verbs that are always let through
MUTATING, CONTROL_VERBS = ("Edit", "Write", "NotebookEdit", "Bash"), ("reasoning", "reset-projection", "reset-routing", "ground")


def control_command(command: Column, executable: str) -> Column:
    """One direct call of the control program, never a shell program that begins with one."""
    words = F.split(F.trim(command), r"\s+")
    name = F.element_at(F.split(F.get(words, F.lit(0)), "/"), -1)
    return F.coalesce(~command.rlike(r"[\n\r;|&><`$()]") & (name == executable) & F.get(words, F.lit(1)).isin(*CONTROL_VERBS), F.lit(False))


def tool_policy(state: Column, tool: Column, command: Column, executable: str = "aeonframe") -> Column:
    """read_only, control_plane, allow or deny, by the state of the active run (null: there is none)."""
    return (
        F.when(~F.coalesce(tool.isin(*MUTATING), F.lit(False)), "read_only")
        .when((tool == "Bash") & control_command(command, executable), "control_plane")
        .when(state == "needs_observation", "allow")
        .when((state == "needs_verification") & (tool == "Bash"), "allow")
        .otherwise("deny")
    )


# -- traces -------------------------------------------------------------------------------------------------
#: fixed values: bytes of a name, links and attributes of a span, at most
TRACE_NAME, TRACE_LINKS, TRACE_ATTRIBUTES = 160, 32, 64


def trace_problems(spans: DataFrame) -> DataFrame:
    """spans (trace_id, span_id, phase, duration, outcome, and if they are there parent_span_id, name, links, attributes).

    A start has no duration and is running, an annotation has no duration, a finish has one and isn't running; ids are
    32 and 16 lower-case hex digits and not all zero; no span is its own parent.
    """
    has = lambda c: c in spans.columns
    ids = F.col("trace_id").rlike("^(?!0{32})[0-9a-f]{32}$") & F.col("span_id").rlike("^(?!0{16})[0-9a-f]{16}$")
    running = F.col("outcome").eqNullSafe(F.lit("running"))
    lasts = F.col("duration").isNotNull()
    no = F.lit(False)
    named = (F.trim("name") == "") | F.col("name").isNull() | (F.octet_length("name") > TRACE_NAME) if has("name") else no
    own = F.col("parent_span_id").eqNullSafe(F.col("span_id")) if has("parent_span_id") else no
    many = (F.size("links") > TRACE_LINKS) if has("links") else no
    wide = (F.size("attributes") > TRACE_ATTRIBUTES) if has("attributes") else no
    problem = (
        F.when(~F.coalesce(ids, no), "id")
        .when(named, "name")
        .when(own, "parent")
        .when(~F.coalesce(F.col("phase").isin("start", "annotation", "finish"), no), "phase")
        .when((F.col("phase") == "start") & (lasts | ~running), "start")
        .when((F.col("phase") == "annotation") & lasts, "annotation")
        .when((F.col("phase") == "finish") & (~lasts | running | F.col("outcome").isNull()), "finish")
        .when(many, "links")
        .when(wide, "attributes")
        .when(F.col("duration") < 0, "duration")
    )
    return spans.withColumn("problem", problem).where("problem is not null")


def open_spans(spans: DataFrame) -> DataFrame:
    done = spans.where("phase = 'finish'").select("trace_id", "span_id")
    return spans.where("phase = 'start'").join(done, ["trace_id", "span_id"], "left_anti")
