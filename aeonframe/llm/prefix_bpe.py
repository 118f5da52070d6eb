"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a byte string there is exactly one token that may end it: the last token of the
prefix's own encoding. Storing that token for every prefix makes the encoding of the whole string a walk
backwards, an append a continuation, and an edit a restart at the first changed byte.

Defined results: a null text counts as empty; an empty text has no ids (zero tokens, the SHA-256 of nothing).
Texts of any length are cut at places that no match of the split pattern crosses, so memory stays bounded.
Repeated rows give repeated results; an empty table gives an empty result; further columns of the input are
ignored unless named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import PieceCache, WordPieces, groups, kept, no_cycles, rows_out, small_batches, text_or_empty


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: bytes of a piece's head, whose last tokens are remembered
HEAD = 6


class PrefixBpe:
    """Ranks of a byte-level BPE vocabulary, and the validity of neighbouring tokens derived from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self._size = {rank: len(token) for rank, token in self.token.items()}
        self._longest = max(map(len, ranks), default=0)
        self._automaton()
        self._heads: dict[bytes, tuple[list[int], int]] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fit: dict[int, bool] = {}

    def _automaton(self) -> None:
        """Aho and Corasick's automaton over the tokens: from the state before a byte to the one after it, and for each
        state the longest token that ends there; for each token the longest other one that ends with it."""
        step: dict[int, int] = {}
        owner, parents, level = [-1], [(0, 0)], [[0]]
        for token, rank in self.ranks.items():
            node = 0
            for depth, byte in enumerate(token, 1):
                key = node << 8 | byte
                node = step.get(key, 0)
                if not node:
                    node = step[key] = len(owner)
                    owner.append(-1)
                    parents.append((key >> 8, byte))
                    if depth == len(level):
                        level.append([])
                    level[depth].append(node)
            owner[node] = rank
        fail, self._ends, self._suffix = [0] * len(owner), list(owner), dict.fromkeys(self.token, -1)
        for nodes in level[1:]:
            for node in nodes:
                parent, byte = parents[node]
                back = fail[parent]
                while parent:
                    found = step.get(back << 8 | byte)
                    if found is not None:
                        fail[node] = found
                        break
                    if not back:
                        break
                    back = fail[back]
                behind = self._ends[fail[node]]
                if owner[node] < 0:
                    self._ends[node] = behind
                else:
                    self._suffix[owner[node]] = behind
        self._step, self._fail, self._known = step, fail, {}

    def _next(self, state: int, byte: int) -> int:
        """The state after a byte; remembered."""
        key, at = state << 8 | byte, state
        found = self._step.get(key)
        while found is None:
            if not at:
                found = 0
                break
            at = self._fail[at]
            found = self._step.get(at << 8 | byte)
        if len(self._known) > 200_000:
            self._known.clear()
        self._known[key] = found
        return found

    # -- merges ---------------------------------------------------------------------------------
    def _merged(self, data: bytes, below: int) -> list[bytes]:
        """The parts that remain when all merges of a rank under ``below`` are made, lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            at, best = -1, below
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and rank < best:
                    at, best = i, rank
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte; (-1, -1) if merges never make it."""
        if token not in self._halves:
            data = self.token[token]
            parts = self._merged(data, token) if len(data) > 1 else []
            self._halves[token] = (
                None if len(data) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
            )
        return self._halves[token]

    def fit(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens.

        Seen from the seam, each side is a chain of tokens that were there one after the other, each until the
        rank of the merge that took it into the next. The pair is valid if no two tokens that met at the seam
        could merge before either was taken.
        """
        known = self._fit.get(left << 20 | right)
        if known is None:
            if len(self._fit) > 400_000:
                self._fit.clear()
            known = self._fit[left << 20 | right] = self.halves(right) != (-1, -1) and self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        left_until = right_until = float("inf")
        while True:
            merged = self.ranks.get(self.token[left] + self.token[right])
            # at equal rank the merge further left goes first: the left side's own merge precedes the seam's
            if merged is not None and merged < left_until and merged <= right_until:
                return False
            inner, outer = self.halves(left), self.halves(right)
            if inner is None and outer is None:
                return True
            if outer is None or (inner is not None and left > right):
                left_until, left = left, inner[1]
            else:
                right_until, right = right, outer[0]

    # -- prefixes -------------------------------------------------------------------------------
    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (one entry for each prefix of ``data`` done so far) up to the whole of ``data``."""
        state, done = 0, len(last)
        for byte in data[max(0, done - self._longest) : done]:
            state = self._next(state, byte)
        self._extend(data, last, state)
        return last

    def _extend(self, data: bytes, last: list[int], state: int) -> int:
        """extend(), with the automaton's state before and after."""
        after, ends, suffix, size, known = self._known.get, self._ends, self._suffix, self._size, self._fit.get
        for end in range(len(last), len(data)):
            byte = data[end]
            to = after(state << 8 | byte)
            state = self._next(state, byte) if to is None else to
            token = ends[state]
            while token >= 0:
                before = end - size[token]
                if before < 0:
                    valid = self.halves(token) != (-1, -1)
                else:
                    left = last[before]
                    valid = known(left << 20 | token)
                    if valid is None:
                        valid = self.fit(left, token)
                if valid:
                    last.append(token)
                    break
                token = suffix[token]
            else:
                raise ValueError("a byte that is no token")
        return state

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        ids, end = [], len(data)
        while end:
            ids.append(last[end - 1])
            end -= self._size[ids[-1]]
        ids.reverse()
        return ids

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        head = data[:HEAD]  # many pieces begin alike: what their first prefixes end with is stored, and appended to
        known = self._heads.get(head)
        if known is None:
            if len(self._heads) > 50_000:
                self._heads.clear()
            last: list[int] = []
            known = self._heads[head] = (last, self._extend(head, last, 0))
        last = known[0].copy()
        self._extend(data, last, known[1])
        return self.walk(data, last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixState:
    """One match of the split pattern that grows or changes: only prefixes behind the change are done again."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.bpe.extend(self.data, self.last)

    def replace(self, begin: int, end: int, data: bytes) -> None:
        self.data = self.data[:begin] + data + self.data[end:]
        del self.last[begin:]
        self.bpe.extend(self.data, self.last)

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return [whole] if whole is not None else self.bpe.walk(self.data, self.last)


class TextEncoder:
    """Encode texts match by match, and encode edited texts again near the edit only."""

    #: a match is fixed once this many characters behind it are known
    AHEAD = 3

    def __init__(self, bpe: PrefixBpe, pattern: str):
        self.bpe, self.pattern = bpe, regex.compile(pattern)

    def pieces(self, text: str) -> list[tuple[str, list[int]]]:
        return [(m, self.bpe.encode_piece(m.encode())) for m in self.pattern.findall(text)]

    def encode(self, text: str) -> list[int]:
        return [i for _, ids in self.pieces(text) for i in ids]

    def edit(self, pieces: list[tuple[str, list[int]]], begin: int, end: int, new: str) -> list[tuple[str, list[int]]]:
        """The pieces of the text whose characters begin to end are replaced by new; begin = end appends or inserts."""
        head, at = [], 0
        for piece in pieces:
            if at + len(piece[0]) + self.AHEAD > begin:
                break
            head.append(piece)
            at += len(piece[0])
        starts, place = {}, 0  # where old pieces behind the edit begin
        for k, piece in enumerate(pieces):
            if place >= end:
                starts[place] = k
            place += len(piece[0])
        old = "".join(p for p, _ in pieces)
        text, shift, middle = old[:begin] + new + old[end:], len(new) - (end - begin), []
        for m in self.pattern.finditer(text, at):
            k = starts.get(m.start() - shift) if m.start() >= begin + len(new) else None
            if k is not None:
                return head + middle + pieces[k:]
            middle.append((m[0], self.bpe.encode_piece(m[0].encode())))
        return head + middle


_DIGEST = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


#: parts and matches that a worker remembers (twice as many at times; some 300 bytes each)
PARTS, MATCHES = 300_000, 100_000


def _pieces_of(path: str, pattern: str) -> WordPieces:
    bpe, split = PrefixBpe(read_ranks(path)), regex.compile(pattern)
    words = {rank: str(rank) for rank in bpe.token}

    def of_matches(matches: list[str]) -> list[tuple[int, str, bytes]]:
        out, encode, token, word = [], bpe.encode_piece, bpe.token.__getitem__, words.__getitem__
        for m in matches:
            ids = encode(m.encode())
            out.append((len(ids), ",".join(map(word, ids)), b"".join(map(token, ids))))
        return out

    matches = PieceCache(of_matches, MATCHES)

    def compute(parts: list[str]) -> list[tuple[int, str, bytes]]:
        # letters alone, but for a blank before them, are one match
        cuts = [[p] if p.isascii() and (p[1:] if p[0] == " " else p).isalpha() else split.findall(p) for p in parts]
        found, out, at = matches.get([m for cut in cuts for m in cut]), [], 0
        for cut in cuts:
            if len(cut) == 1:
                out.append(found[at])
            else:
                n, ids, raw = zip(*found[at : at + len(cut)])
                out.append((sum(n), ",".join(ids), b"".join(raw)))
            at += len(cut)
        return out

    return WordPieces(compute, PARTS)


def bpe_digests(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, with the number of ids, the SHA-256 of their decimals and that of the decoded bytes."""
    small_batches(df.sparkSession)
    narrow = df.select(*keep, text_or_empty(df, text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept((path, pattern), lambda: _pieces_of(path, pattern))
        for batch in batches:
            out: list[list] = [[], [], []]
            with no_cycles():
                for group in groups(batch.column(batch.num_columns - 1).to_pylist()):
                    for many in pieces.get_all(group):
                        n, ids, raw, began = 0, hashlib.sha256(), hashlib.sha256(), False
                        for found in many:
                            if found:
                                counts, words, data = zip(*found)
                                n += sum(counts)
                                ids.update((("," if began else "") + ",".join(words)).encode())
                                raw.update(b"".join(data))
                                began = True
                        out[0].append(n)
                        out[1].append(ids.hexdigest())
                        out[2].append(raw.hexdigest())
            made = rows_out(_DIGEST, out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made.columns], names=[*keep, *_DIGEST.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{kinds}{', ' if kinds else ''}n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_ids(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with a column ids (array of int): the ids of each text."""
    small_batches(df.sparkSession)

    import pandas as pd

    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = TextEncoder(PrefixBpe(read_ranks(path)), pattern)
        for s in parts:
            yield pd.Series([encoder.encode(t or "") for t in s])

    encode.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}  # annotations are text in this module
    return df.withColumn("ids", F.pandas_udf(encode, "array<int>")(text_or_empty(df, text)))
