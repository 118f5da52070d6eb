"""The query language: ``FROM family:type AT VALID t KNOWN c [WHERE a = x AND ...] [PROJECT ...] [LIMIT n] [EXPLAIN CONTRACT]``.

A text becomes an AST, the AST is bound against a catalog (fields, types, parameters, the log's head), and the bound
query is one DataFrame: Catalyst does the rest. Nothing is read before binding has succeeded.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph, temporal

MAX_ROWS, MAX_BYTES, BATCH = 10_000, 8 << 20, 256
U64 = (1 << 64) - 1


class QueryError(ValueError):
    def __init__(self, at: int, what: str):
        super().__init__(f"at {at}: {what}")
        self.at = at


# -- text to AST --------------------------------------------------------------------------------------------
_TOKEN = re.compile(r"""[ \t\n\r\f\v]*(?:(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>[0-9]+)|(?P<mark>[:,=*])|(?P<word>[^\s:,=*"]+)|(?P<bad>\S))""", re.S)
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "r": "\r", "t": "\t"}
_FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")


@dataclass(frozen=True)
class Param:
    name: str

    def __str__(self) -> str:
        return f"${self.name}"


@dataclass(frozen=True)
class Query:
    family: str
    kind: str | None
    valid_at: int | Param
    known_at: int | Param | None  # None: HEAD
    filters: tuple[tuple[str, object], ...] = ()
    fields: tuple[str, ...] | None = None  # None: *
    limit: int | None = None
    explain: bool = False

    def __str__(self) -> str:
        out = [f"FROM {self.family}" + (f":{self.kind}" if self.kind is not None else ""), f"AT VALID {self.valid_at} KNOWN {'HEAD' if self.known_at is None else self.known_at}"]
        if self.filters:
            out.append("WHERE " + " AND ".join(f"{k} = {_literal(v)}" for k, v in self.filters))
        out.append("PROJECT " + ("*" if self.fields is None else ", ".join(self.fields)))
        if self.limit is not None:
            out.append(f"LIMIT {self.limit}")
        return " ".join(out + ["EXPLAIN CONTRACT"] * self.explain)


def _literal(v: object) -> str:
    if isinstance(v, str):
        back = {raw: mark for mark, raw in _ESCAPES.items()}
        return '"' + "".join("\\" + back[c] if c in back else c for c in v) + '"'
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _unquote(text: str, at: int) -> str:
    def one(m):
        if m[1] not in _ESCAPES:
            raise QueryError(at + m.start(), "no such escape")
        return _ESCAPES[m[1]]

    return re.sub(r"\\(.)", one, text[1:-1], flags=re.S)


def tokens(text: str) -> list[tuple[str, object, int]]:
    out, end = [], len(text.rstrip())
    at = 0
    while at < end:
        m = _TOKEN.match(text, at)
        kind, begin = m.lastgroup, m.start(m.lastgroup)
        if kind == "bad":
            raise QueryError(begin, "a string that doesn't end" if m[kind] == '"' else "a character that means nothing")
        value: object = m[kind]
        if kind == "number" and (value := int(m[kind])) > U64:
            raise QueryError(begin, "a number beyond 64 bits")
        if kind == "string":
            value = _unquote(m[kind], begin)
        out.append((kind, value, begin))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.rest, self.end = tokens(text), len(text)
        self.rest.reverse()

    def at(self) -> int:
        return self.rest[-1][2] if self.rest else self.end

    def take(self, what: str, *kinds: str) -> tuple[str, object, int]:
        if not self.rest or self.rest[-1][0] not in kinds:
            raise QueryError(self.at(), f"expected {what}")
        return self.rest.pop()

    def is_word(self, word: str) -> bool:
        return bool(self.rest) and self.rest[-1][0] == "word" and self.rest[-1][1].upper() == word

    def word(self, word: str) -> None:
        if not self.is_word(word):
            raise QueryError(self.at(), f"expected {word}")
        self.rest.pop()

    def is_mark(self, mark: str) -> bool:
        return bool(self.rest) and self.rest[-1][:2] == ("mark", mark)

    def name(self, what: str) -> str:
        _, value, at = self.take(what, "word")
        if not _FIELD.fullmatch(value):
            raise QueryError(at, f"no {what}: {value}")
        return value

    def time(self, what: str, head: bool = False):
        kind, value, at = self.take(what, "number", "word")
        if kind == "number":
            return value
        if head and value.upper() == "HEAD":
            return None
        return self.param(value, at)

    @staticmethod
    def param(value: str, at: int) -> Param:
        if not re.fullmatch(r"\$[A-Za-z_]\w*", value):
            raise QueryError(at, f"no parameter: {value}")
        return Param(value[1:])

    def value(self) -> object:
        kind, value, at = self.take("a value", "string", "number", "word")
        if kind != "word":
            return value
        plain = {"TRUE": True, "FALSE": False, "NULL": None}
        return plain[value.upper()] if value.upper() in plain else self.param(value, at)


def parse(text: str) -> Query:
    r = _Reader(text)
    r.word("FROM")
    _, family, at = r.take("a source", "word")
    family, kind = family.lower(), None
    if family not in ("record", "relation", "event", "claim"):
        raise QueryError(at, f"no source family {family}")
    if r.is_mark(":") or family != "claim":
        if not r.is_mark(":"):
            raise QueryError(r.at(), "expected ':'")
        r.rest.pop()
        kind = r.take("a type", "word")[1]
    r.word("AT")
    r.word("VALID")
    valid = r.time("a time")
    r.word("KNOWN")
    known = r.time("a cursor", head=True)
    seen: dict[str, object] = {}
    while r.rest:
        clause = next((c for c in ("WHERE", "PROJECT", "LIMIT", "EXPLAIN") if r.is_word(c)), None)
        if clause is None:
            raise QueryError(r.at(), "expected a clause")
        if clause in seen:
            raise QueryError(r.at(), f"{clause} twice")
        at = r.rest.pop()[2]
        if clause == "WHERE":
            found = []
            while True:
                name = r.name("field")
                if not r.is_mark("="):
                    raise QueryError(r.at(), "expected '='")
                r.rest.pop()
                found.append((name, r.value()))
                if not r.is_word("AND"):
                    break
                r.rest.pop()
            seen[clause] = tuple(found)
        elif clause == "PROJECT":
            if r.is_mark("*"):
                r.rest.pop()
                seen[clause] = None
                continue
            names = [r.name("field")]
            while r.is_mark(","):
                r.rest.pop()
                names.append(r.name("field"))
            seen[clause] = tuple(names)
        elif clause == "LIMIT":
            seen[clause] = r.take("a number of rows", "number")[1]
            if not seen[clause]:
                raise QueryError(at, "LIMIT is 1 or more")
        else:
            r.word("CONTRACT")
            seen[clause] = True
    return Query(family, kind, valid, known, seen.get("WHERE", ()), seen.get("PROJECT"), seen.get("LIMIT"), bool(seen.get("EXPLAIN")))


# -- binding ------------------------------------------------------------------------------------------------
BUILT_IN = {
    "record": {"id": "string", "kind": "string", "valid_from": "unsigned", "valid_to": "unsigned"},
    "relation": {"id": "string", "kind": "string", "from_kind": "string", "from_id": "string", "to_kind": "string", "to_id": "string", "valid_from": "unsigned", "valid_to": "unsigned"},
    "event": {"cursor": "unsigned", "kind": "string", "at": "unsigned", "actor": "string", "subject_kind": "string", "subject_id": "string"},
    "claim": {"subject": "string", "predicate": "string", "object": "string", "valid_from": "unsigned", "valid_to": "unsigned", "tx_time": "unsigned", "actor": "string"},
}
_NULLABLE = {"valid_to", "subject_kind", "subject_id"}


@dataclass
class Catalog:
    """The log's tables, its head, and what properties each (family, kind) declares: name to (type, required)."""

    head: int
    records: DataFrame | None = None
    relations: DataFrame | None = None
    events: DataFrame | None = None
    claims: DataFrame | None = None
    properties: dict[tuple[str, str], dict[str, tuple[str, bool]]] = field(default_factory=dict)
    revision: int = 1
    max_changes: int | None = None  # a budget for interactive use; a batch query has none

    def fields(self, q: Query) -> dict[str, tuple[str, bool, bool]]:
        """name: type, may be null or absent, built in."""
        out = {k: (t, k in _NULLABLE, True) for k, t in BUILT_IN[q.family].items()}
        if q.family != "claim":
            if (q.family, q.kind) not in self.properties:
                raise QueryError(0, f"no {q.family} {q.kind} in the catalog")
            out |= {k: (t, not required, False) for k, (t, required) in self.properties[q.family, q.kind].items() if k not in out}
        return out


@dataclass
class Bound:
    query: Query
    valid_at: int
    known_at: int
    filters: tuple[tuple[str, object], ...]
    fields: dict[str, tuple[str, bool, bool]]
    plan: dict

    @property
    def digest(self) -> str:
        return plan_digest(self.plan)


def plan_digest(plan: dict) -> str:
    return hashlib.sha256(json.dumps(plan, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _type(v: object) -> str:
    return "null" if v is None else "bool" if isinstance(v, bool) else "string" if isinstance(v, str) else "unsigned" if v >= 0 else "integer"


def bind(q: Query, catalog: Catalog, params: dict[str, object] | None = None) -> Bound:
    params = params or {}

    def given(x: object) -> object:
        if isinstance(x, Param):
            if x.name not in params:
                raise QueryError(0, f"no value for {x}")
            return params[x.name]
        return x

    def moment(x: object, what: str) -> int:
        v = given(x)
        if not isinstance(v, int) or isinstance(v, bool) or not 0 <= v <= (1 << 63) - 1:
            raise QueryError(0, f"{what} is an unsigned number")
        return v

    valid = moment(q.valid_at, "valid time")
    known = catalog.head if q.known_at is None else moment(q.known_at, "the known cursor")
    if known > catalog.head:
        raise QueryError(0, f"cursor {known} is beyond the head {catalog.head}")
    if catalog.max_changes is not None and known > catalog.max_changes:
        raise QueryError(0, f"{known} changes are more than the {catalog.max_changes} that a query may scan")
    fields, filters = catalog.fields(q), []
    for name, value in q.filters:
        if name not in fields:
            raise QueryError(0, f"no field {name}")
        v, (kind, optional, _) = given(value), fields[name]
        if _type(v) not in (kind, "null") or (v is None and not optional):
            raise QueryError(0, f"{name} is {kind}, not {_type(v)}")
        filters.append((name, v))
    for name in q.fields or ():
        if name not in fields:
            raise QueryError(0, f"no field {name}")
    plan = {
        "query": str(q), "scan": {"family": q.family, "kind": q.kind, "cursor": known}, "temporal": {"valid_at": valid},
        "filter": [[n, _type(v), v] for n, v in filters], "project": list(q.fields) if q.fields is not None else "*", "limit": q.limit,
        "order": "identity", "path": "log_scan", "rejected": [{"path": "index", "reason": "no index holds this source"}], "revision": catalog.revision, "head": catalog.head,
    }
    return Bound(q, valid, known, tuple(filters), fields, plan)


# -- a bound query as a DataFrame ---------------------------------------------------------------------------
def _source(b: Bound, c: Catalog) -> tuple[DataFrame, Column]:
    """Rows in force and their identity. Kinds never share an identity, so the kind's filter goes to the scan."""
    q = b.query
    if q.family == "record":
        return graph.latest(c.records.where(F.col("kind") == q.kind), b.valid_at, b.known_at), F.concat_ws(":", F.lit("record"), "kind", "id")
    if q.family == "relation":
        return graph.latest(c.relations.where(F.col("kind") == q.kind), b.valid_at, b.known_at), F.concat_ws(":", F.lit("relation"), "kind", "id")
    if q.family == "event":
        rows = c.events.where((F.col("kind") == q.kind) & (F.col("cursor") <= b.known_at) & (F.col("at") <= b.valid_at))
        return rows, F.concat_ws(":", F.lit("event"), "kind", F.col("cursor").cast("string"))
    rows = c.claims.where(F.col("seq") <= b.known_at)
    rows = rows.where(F.col("predicate") == q.kind) if q.kind is not None else rows
    return temporal.as_of(rows, b.valid_at), F.concat_ws(":", F.lit("claim"), "subject", "predicate")


def _cell(name: str, kind: str, built_in: bool) -> Column:
    if built_in:
        return F.col(name)
    text = F.element_at("properties", F.lit(name))["value"]
    return text.cast({"unsigned": "long", "integer": "long", "bool": "boolean"}.get(kind, "string"))


def execute(b: Bound, catalog: Catalog) -> DataFrame:
    """identity and the projected fields, in the order of identity: all rows, unless the query has a limit."""
    rows, identity = _source(b, catalog)
    for name, value in b.filters:
        kind, _, built_in = b.fields[name]
        if built_in:
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
        else:  # tag and value; a missing property equals nothing
            found = F.element_at("properties", F.lit(name))
            text = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
            rows = rows.where(F.coalesce((found["type"] == _type(value)) & found["value"].eqNullSafe(F.lit(text)), F.lit(False)))
    names = list(b.query.fields) if b.query.fields is not None else list(b.fields)
    out = rows.select(identity.alias("identity"), *[_cell(n, b.fields[n][0], b.fields[n][2]).alias(n) for n in dict.fromkeys(names)])
    ordered = out.orderBy("identity")
    return ordered if b.query.limit is None else ordered.limit(b.query.limit)


@dataclass(frozen=True)
class Answer:
    """Rows within a budget, each with its batch, and whether the budget cut any."""

    rows: DataFrame
    truncated: bool


def answer(b: Bound, catalog: Catalog, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Answer:
    """execute() within a budget of rows and of bytes of JSON."""
    from ..operators.graph import materialize

    found = budgeted(execute(b, catalog).limit(max_rows + 1), max_bytes).withColumn("kept", F.col("kept") & (F.col("place") <= max_rows))
    held = materialize(found, "answer")
    return Answer(held.where("kept").drop("kept", "place", "bytes_so_far").orderBy("identity"), not held.where("not kept").isEmpty())


def run(text: str, catalog: Catalog, params: dict[str, object] | None = None) -> DataFrame:
    b = bind(parse(text), catalog, params)
    if b.query.explain:
        return catalog_frame(catalog).sparkSession.createDataFrame([(json.dumps(b.plan, sort_keys=True), b.digest)], "contract string, digest string")
    return execute(b, catalog)


def catalog_frame(c: Catalog) -> DataFrame:
    return next(d for d in (c.records, c.relations, c.events, c.claims) if d is not None)


def verify_plan(plan: dict, digest: str) -> None:
    if plan_digest(plan) != digest:
        raise ValueError("the plan isn't the one that was digested")


def budgeted(rows: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A result of bounded rows with its place, its batch (of 256) and whether its JSON is within a size. The running sum
    is over rows that a limit bounds, so one task is enough."""
    order = W.orderBy("identity")
    size = F.octet_length(F.to_json(F.struct(*rows.columns)))
    sized = rows.withColumn("bytes_so_far", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order)).withColumn("batch", F.floor((F.col("place") - 1) / BATCH).cast("int"))
    return sized.withColumn("kept", F.col("bytes_so_far") <= max_bytes)
