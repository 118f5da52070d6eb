"""The change log as a feed: pages, commits, outbox, audit, leases and ledgers."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .integrity import GENESIS, chain, digest


def page(log: DataFrame, after: int, limit: int, head: int, scope: str | None = None) -> tuple[DataFrame, int]:
    """The changes at the ``limit`` positions behind ``after``, of one scope if asked; and the cursor to go on from, which
    advances over positions of other scopes too."""
    through = min(after + limit, head)
    rows = log.where((F.col("cursor") > after) & (F.col("cursor") <= through))
    return (rows.where(F.col("scope") == scope) if scope is not None else rows).orderBy("cursor"), through


def family(mutation: Column) -> Column:
    """Which projection follows a mutation; claims and schemas have none."""
    return F.when(mutation == "record", "scalar").when(mutation.isin("relation", "event"), "graph").when(mutation == "sample", "time_series").when(mutation.isin("vector", "geo", "object"), mutation)


def outbox(log: DataFrame) -> DataFrame:
    """log (scope, cursor, commit_id, commit_ordinal, mutation): one piece of work for each change that a projection
    follows, named by all that identifies the change."""
    name = F.sha2(F.concat_ws("|", "scope", F.col("cursor").cast("string"), "commit_id", F.col("commit_ordinal").cast("string"), "family"), 256)
    work = log.withColumn("family", family(F.col("mutation"))).where("family is not null")
    return work.select(name.alias("work_id"), "scope", "family", "commit_id", "commit_ordinal", F.col("cursor").alias("source_cursor"))


def outbox_page(work: DataFrame, after: int, limit: int) -> DataFrame:
    return work.where(F.col("source_cursor") > after).orderBy("source_cursor", "work_id").limit(limit)


#: fixed values: the class of a trace by its domain, and of other events by their stage
DOMAINS = {"reasoning": "reasoning", "lifecycle": "workflow", "tool": "workflow", "query": "routing", "planning": "routing", "projection": "search", "search": "search", "embedding": "search", "model": "model"}
STAGES = {"context": "routing", "recall": "routing", "routing": "routing", "tools": "workflow", "outcome": "reasoning"}


def classify(mutation: Column, kind: Column, subject: Column, properties: Column) -> Column:
    """The class and operation of a change, as struct(class, operation). kind is that of a record, relation or event,
    subject that of a claim, properties the tagged ones of an event."""

    def text(name: str) -> Column:
        found = F.element_at(properties, F.lit(name))
        return F.when(found["type"].isin("string", "digest"), found["value"])

    def among(value: Column, table: dict[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.coalesce(value, F.lit("")))

    trace = (mutation == "event") & (kind == "runtime_trace")
    by_kind = F.when(kind.startswith("reasoning_"), "reasoning").when(kind.startswith("prompt_flight") & (mutation != "relation"), "model").otherwise("storage")
    name = (
        F.when(mutation == "claim", F.when(subject.startswith("package:"), "workflow").otherwise("memory"))
        .when(trace, F.coalesce(among(text("domain"), DOMAINS), F.lit("storage")))
        .when(mutation == "event", F.coalesce(among(text("stage"), STAGES), by_kind))
        .when(mutation.isin("record", "relation"), by_kind)
        .when(mutation == "vector", "search")
        .when(mutation.isin("sample", "geo"), "data")
        .otherwise("storage")
    )
    operation = F.when(trace, F.concat(F.lit("trace_"), F.coalesce(text("phase"), F.lit("unknown")))).when(mutation == "sample", "series_sample").otherwise(mutation)
    return F.struct(name.alias("class"), operation.alias("operation"))


def temporal_events(events: DataFrame, audit: DataFrame, newest: int, head: int) -> DataFrame:
    """The newest (1 to 4096) changes, with their class and, if there is one, the audit of their commit."""
    n = max(1, min(4096, newest))
    return events.where(F.col("cursor") > head - n).join(audit, "commit_id", "left")


def seal(rows: list[dict], head: int, previous: str = GENESIS) -> list[dict]:
    """Cursors and chained digests for a commit's mutations, which one writer gives out."""
    bodies = [json.dumps(r, sort_keys=True, separators=(",", ":")) for r in rows]
    return [{**r, "cursor": head + k + 1, "previous_digest": p, "digest": d, "body": b} for k, (r, b, (p, d)) in enumerate(zip(rows, bodies, chain(bodies, previous)))]


class Conflict(RuntimeError):
    pass


_LOG = "scope string, cursor long, commit_id string, commit_ordinal long, at long, actor string, mutation string, body string, previous_digest string, digest string"
#: what a commit may hold, and the fields that it must have
MUTATIONS = {"claim": (), "schema": (), "record": ("id",), "relation": ("id",), "event": ("id",), "vector": ("id",), "sample": ("id",), "geo": ("id",), "object": ("id",)}


@dataclass
class Log:
    """A single writer's append-only log in Parquet, which any later writer goes on with.

    A commit names the cursor it expects; a commit that is tried again (the same digest) changes nothing, whoever wrote
    it. Each commit is written aside and put in place by a rename, so a directory that readers see is complete; head and
    last digest are read from the newest one.
    """

    spark: SparkSession
    path: str
    scope: str = "main"
    head: int = field(default=0, init=False)
    last: str = field(default=GENESIS, init=False)

    def __post_init__(self):
        self.refresh()

    def _place(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _newest(self) -> str | None:
        fs, root = self._place()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return max((n for n in names if n.startswith("commit=")), default=None)

    def refresh(self) -> None:
        newest = self._newest()
        if newest is not None:
            row = self.spark.read.schema(_LOG).parquet(f"{self.path}/{newest}").orderBy(F.desc("cursor")).first()
            self.head, self.last = row["cursor"], row["digest"]

    def commit(self, mutations: list[dict], expected: int, at: int, actor: str) -> tuple[int, int]:
        """(first, last) cursor of the commit."""
        if not mutations:
            raise ValueError("a commit has a mutation")
        name = digest(self.scope, at, actor, expected, [json.dumps(m, sort_keys=True) for m in mutations])
        self.refresh()
        if expected != self.head:
            done = self.read().where(F.col("commit_id") == name).agg(F.min("cursor").alias("a"), F.max("cursor").alias("b")).first()
            if done["a"] is not None:
                return done["a"], done["b"]
            raise Conflict(f"the log is at {self.head}, not at {expected}")
        for m in mutations:
            lacking = [f for f in MUTATIONS.get(m.get("mutation"), ("mutation",)) if not m.get(f)]
            if lacking or m.get("mutation") not in MUTATIONS:
                raise ValueError(f"a mutation lacks {', '.join(lacking)}: {m}")
        sealed = seal([{**m, "at": at, "actor": actor} for m in mutations], self.head, self.last)
        rows = [(self.scope, r["cursor"], name, k, at, actor, r["mutation"], r["body"], r["previous_digest"], r["digest"]) for k, r in enumerate(sealed)]
        aside, final = f"_staging/{uuid.uuid4().hex}", f"commit={self.head + 1:020d}"
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.parquet(f"{self.path}/{aside}")
        fs, target = self._place(final)
        if fs.exists(target) or not fs.rename(self._place(aside)[1], target):
            raise Conflict(f"another writer has put cursor {self.head + 1} in place")
        self.head, self.last = self.head + len(rows), sealed[-1]["digest"]
        return self.head - len(rows) + 1, self.head

    def read(self) -> DataFrame:
        if self._newest() is None:
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(self.path)

    def outbox(self) -> DataFrame:
        """The work that the log's changes leave to projections."""
        return outbox(self.read())

    def audit(self) -> DataFrame:
        """Who committed what, when: a row for each commit."""
        return self.read().groupBy("commit_id").agg(F.first("actor").alias("actor"), F.first("at").alias("at"), F.min("cursor").alias("first"), F.max("cursor").alias("last"))

    def stamp(self) -> dict:
        """Scope, cursor and head digest, named by their digest."""
        body = {"scope": self.scope, "cursor": self.head, "digest": self.last}
        return {**body, "stamp_id": digest(self.scope, self.head, self.last)}


def valid_stamp(stamp: dict) -> bool:
    return stamp.get("stamp_id") == digest(stamp["scope"], stamp["cursor"], stamp["digest"])


def read_stamped(log: DataFrame, stamp: dict, after: int, limit: int) -> tuple[DataFrame, int]:
    if not valid_stamp(stamp):
        raise ValueError("the stamp is not what its id says")
    return page(log, after, limit, stamp["cursor"], stamp["scope"])


class Leases:
    """Leases over read stamps: live while now < expires; the least cursor of the live ones is the retention floor."""

    def __init__(self):
        self.rows: dict[str, dict] = {}

    def open(self, stamp: dict, owner: str, ttl: int, now: int | None = None) -> str:
        now = int(time.time() * 1000) if now is None else now
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{stamp['stamp_id']}|{owner}|{now}").hex
        self.rows[name] = {"lease": name, "owner": owner, "cursor": stamp["cursor"], "expires_at": now + ttl}
        return name

    def release(self, name: str) -> None:
        self.rows.pop(name, None)

    def live(self, now: int) -> list[dict]:
        return sorted((r for r in self.rows.values() if now < r["expires_at"]), key=lambda r: r["lease"])

    def floor(self, now: int) -> int | None:
        return min((r["cursor"] for r in self.live(now)), default=None)


def retention(leases: DataFrame, now: int) -> DataFrame:
    return leases.where(F.col("expires_at") > now).agg(F.count("*").alias("pins"), F.min("cursor").alias("floor"))


def unseen(batch: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of commits that the log hasn't: what makes a sink idempotent."""
    return batch.join(commits.select("commit_id").distinct(), "commit_id", "left_anti")


def judge(invocations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """invocations (ordinal, command, outcome) with the latest verdict (ordinal, at, outcome) on each recall."""
    last = verdicts.groupBy("ordinal").agg(F.max_by("outcome", "at").alias("judged"))
    both = invocations.join(last, "ordinal", "left")
    bad = F.col("judged").isNotNull() & (F.col("command") != "recall")
    return both.withColumn("outcome", F.when(bad, F.raise_error(F.lit("only a recall is judged")).cast("string")).otherwise(F.coalesce("judged", "outcome"))).drop("judged")


def outcome_distribution(invocations: DataFrame) -> DataFrame:
    return invocations.where("command = 'recall'").groupBy("outcome").agg(F.count("*").alias("n"))


def trial_summary(trials: DataFrame) -> DataFrame:
    """trials (provider, scenario, arm, success, input_tokens, output_tokens, latency_ms). A regression is a failure with
    the runtime where the baseline succeeded for the same provider and scenario; tokens count where both are known."""
    good = trials.where("arm = 'baseline' and success").select("provider", "scenario").distinct().withColumn("good", F.lit(True))
    both = trials.join(good, ["provider", "scenario"], "left")
    tokens = F.when(F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull(), F.col("input_tokens") + F.col("output_tokens"))
    return both.agg(
        F.count("*").alias("trials"), F.count_if("success").alias("successes"),
        F.count_if((F.col("arm") == "runtime") & ~F.col("success") & F.coalesce("good", F.lit(False))).alias("regressions"),
        F.sum("latency_ms").alias("latency_ms"), F.sum(tokens).alias("tokens"),
    )


def prompt_cohorts(prompts: DataFrame) -> DataFrame:
    """How many prompts are alike but for white space (of any script) at their ends."""
    return prompts.groupBy(F.sha2(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), 256).alias("cohort")).agg(F.count("*").alias("n"))
