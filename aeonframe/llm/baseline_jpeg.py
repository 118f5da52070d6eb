"""Media columns of baseline JPEG: luminance thumbnails from the DC coefficients, read without an inverse transform.

The reader parses the markers of baseline (sequential, 8-bit, Huffman) JPEG streams, decodes their scans and keeps
only DC coefficients: one pixel for each 8x8 block. All restart intervals of all images of a batch are decoded side
by side, one numpy lane each. The writer makes grey images of flat blocks: with a quantizer of 8, a block's DC
coefficient is its grey value, so a sample is one block, any viewer shows it, and the thumbnail gives it back.

Payload bytes are laid out as rows of 64 samples, each row a restart interval; payloads over ROWS rows go to several
images, one after the other in one media value.

Defined results: a null text counts as empty; an empty text is stored as 64 zero bytes; equal texts have equal media;
a media value that is null, or no baseline JPEG, or one with a scan for each component, has a null thumbnail
(``thumbnails``); an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import fresh_path, small_batches, text_or_empty

COLUMNS, ROWS = 64, 4096
#: bytes of payload that are encoded or decoded at once
_AT_ONCE = 1 << 20

#: DC codes by length: differences of neighbouring letters are mostly of sizes 3, 4 and, about a blank, 7
_DC_LENGTHS = {4: 2, 7: 2, 3: 3, 0: 4, 2: 4, 5: 4, 1: 5, 8: 5, 6: 6}
_AC_LENGTHS = {0: 1}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), in the order in which a table segment lists symbols."""
    out, code, before = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - before
        out[symbol], before = (code, n), n
        code += 1
    return out


def _table_segment(place: int, lengths: dict[int, int]) -> bytes:
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return bytes([place, *counts, *[s for s, _ in sorted(lengths.items(), key=lambda x: x[1])]])


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _head(rows: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _marker(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _marker(0xDB, bytes([0] + [8] * 64)),
        _marker(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, COLUMNS * 8, 1, 1, 0x11, 0)),
        _marker(0xC4, _table_segment(0x00, _DC_LENGTHS) + _table_segment(0x10, _AC_LENGTHS)),
        _marker(0xDD, struct.pack(">H", COLUMNS)),
        _marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


@lru_cache(maxsize=1)
def _words() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: the bits of a block (DC code, magnitude, end of block), and how many they are."""
    dc, (end, end_n) = _codes(_DC_LENGTHS), _codes(_AC_LENGTHS)[0]
    words, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, n = dc[size]
        magnitude = diff if diff >= 0 else diff + (1 << size) - 1
        words[diff + 255] = ((code << size | magnitude) << end_n) | end
        sizes[diff + 255] = n + size + end_n
    return words, sizes


def _encode_rows(samples: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The scan bytes of rows of samples, and where each row ends. first[i]: i is the first row of an image."""
    words, sizes = _words()
    level = samples.astype(np.int64) - 128
    diff = np.diff(level, axis=1, prepend=0) + 255
    size = sizes[diff]
    ends = np.cumsum(size, axis=1)
    n_bytes = (ends[:, -1] + 7) >> 3
    row_begin = np.cumsum(n_bytes) - n_bytes
    bit = (ends - size) + 8 * row_begin[:, None]
    value = words[diff] << (24 - size - (bit & 7))
    at, total = (bit >> 3).ravel(), int(n_bytes.sum()) + 2
    value = value.ravel()
    out = sum(np.bincount(at + k, (value >> (16 - 8 * k)) & 255, total) for k in range(3)).astype(np.int64)
    spare = 8 * n_bytes - ends[:, -1]
    out[row_begin + n_bytes - 1] |= (1 << spare) - 1
    out = out[:-2].astype(np.uint8)
    stuffed = np.flatnonzero(out == 255) + 1
    row = np.arange(len(samples))
    since = row - np.maximum.accumulate(np.where(first, row, 0))
    cut = row_begin[~first]
    number = (0xD0 + (since[~first] - 1) % 8).astype(np.uint8)
    where = np.concatenate([stuffed, cut, cut])
    what = np.concatenate([np.zeros(len(stuffed), np.uint8), np.full(len(cut), 255, np.uint8), number])
    done = np.insert(out, where, what)
    plain_end = row_begin + n_bytes
    # a stuffed byte belongs to the row of its 255; a restart marker, to the row that follows it
    extra = np.searchsorted(np.sort(stuffed), plain_end, "right") + 2 * np.searchsorted(cut, plain_end, "left")
    return done.tobytes(), plain_end + extra


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A media value for each payload, whose length is a positive multiple of 64."""
    images, begin = [], 0  # rows of each image
    first: list[int] = []
    for p in payloads:
        own, rows = [], len(p) // COLUMNS
        for at in range(0, rows, ROWS):
            own.append(min(ROWS, rows - at))
            first.append(begin)
            begin += own[-1]
        images.append(own)
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, COLUMNS)
    starts = np.zeros(len(samples), bool)
    starts[first] = True
    scan, ends = _encode_rows(samples, starts)
    out, row, at = [], 0, 0
    for own in images:
        parts = []
        for rows in own:
            row += rows
            parts += [_head(rows), scan[at : int(ends[row - 1])], b"\xff\xd9"]
            at = int(ends[row - 1])
        out.append(b"".join(parts))
    return out


# -- reading ------------------------------------------------------------------------------------------------
class _Image:
    """What the markers of one image say, and where its scan is."""

    def __init__(self, data: bytes, at: int = 0):
        self.quant, self.tables, self.restart = {}, {}, 0
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker where one is due")
            while data[at + 1] == 0xFF:
                at += 1
            code, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if code == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    self.quant[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                    k += 1 + 64 * (1 + wide)
            elif code == 0xC0:
                depth, self.height, self.width, n_parts = struct.unpack_from(">BHHB", body)
                if depth != 8 or not self.height or not self.width:
                    raise ValueError("not of 8 bits, or of no extent")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n_parts)]
            elif 0xC1 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif code == 0xC4:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    m = sum(counts)
                    self.tables[body[k]] = (bytes(counts), body[k + 17 : k + 17 + m])
                    k += 17 + m
            elif code == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif code == 0xDA:
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                if set(chosen) != {p[0] for p in self.parts}:
                    raise ValueError("a scan for each component")
                self.begin = at
                break
        # the end: a marker other than a stuffed byte or a restart
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise ValueError("no end of image")
            if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                at += 2
                continue
            break
        self.end, self.after = at, at + 2
        single = len(self.parts) == 1
        parts = [(1, 1) if single else (h, v) for _, h, v, _ in self.parts]
        self.most = (max(h for h, _ in parts), max(v for _, v in parts))
        self.across = -(-self.width // (8 * self.most[0]))
        self.down = -(-self.height // (8 * self.most[1]))
        #: for each block of an MCU: its component's number, DC and AC table
        self.units = tuple(
            (k, self.tables[chosen[p[0]] >> 4], self.tables[0x10 | chosen[p[0]] & 15])
            for k, (p, (h, v)) in enumerate(zip(self.parts, parts)) for _ in range(h * v)
        )
        self.luma = parts[0]
        self.scale = self.quant[self.parts[0][3]]


@lru_cache(maxsize=32)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: the code's length << 8 | symbol, or 0 where no code begins."""
    table, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _scan_dc(scan: np.ndarray, begins: np.ndarray, mcus: np.ndarray, units: tuple) -> list[np.ndarray]:
    """For each unit of an MCU, the DC values (lane by MCU), all lanes decoded side by side.

    scan: bytes without stuffing and markers; begins: each lane's first byte; mcus: how many MCUs it holds.
    """
    wide = np.concatenate([scan, np.full(8, 255, np.uint8)]).astype(np.int64)
    window = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    last = len(window) - 1

    def peek(bit: np.ndarray) -> np.ndarray:
        return (window[np.minimum(bit >> 3, last)] >> (16 - (bit & 7))) & 0xFFFF

    bit, most = begins.astype(np.int64) * 8, int(mcus.max(initial=0))
    before = {k: np.zeros(len(begins), np.int64) for k, _, _ in units}
    out = [np.zeros((len(begins), most), np.int64) for _ in units]
    every = np.arange(len(begins))
    for m in range(most):
        lanes = every if mcus.min() > m else np.flatnonzero(mcus > m)
        for u, (part, dc, ac) in enumerate(units):
            at = bit[lanes]
            found = _lookup(*dc)[peek(at)]
            if not found.all():
                raise ValueError("bits that are no code")
            at += found >> 8
            size = found & 255
            raw = peek(at) >> (16 - size)
            at += size
            before[part][lanes] += np.where(raw >= (1 << size) >> 1, raw, raw - (1 << size) + 1) * (size > 0)
            out[u][lanes, m] = before[part][lanes]
            table, place = _lookup(*ac), np.ones(len(lanes), np.int64)
            found = table[peek(at)]
            at += found >> 8
            open_ = np.flatnonzero(found & 255)
            if not (found >> 8).all():
                raise ValueError("bits that are no code")
            while len(open_):  # coefficients other than an end of block
                symbol = found[open_] & 255
                run, size = symbol >> 4, symbol & 15
                at[open_] += size
                place[open_] += run + 1
                open_ = open_[place[open_] < 64]
                found[open_] = table[peek(at[open_])]
                if not (found[open_] >> 8).all():
                    raise ValueError("bits that are no code")
                at[open_] += found[open_] >> 8
                open_ = open_[(found[open_] & 255) > 0]
            bit[lanes] = at
    return out


def _decode_group(images: list[tuple[bytes, _Image]]) -> list[np.ndarray]:
    """Thumbnails of images with the same tables, restart interval and sampling."""
    scans = [np.frombuffer(d, np.uint8, i.end - i.begin, i.begin) for d, i in images]
    raw = np.concatenate([*scans, np.zeros(1, np.uint8)])
    marked, follows = raw[:-1] == 255, raw[1:]
    restart = marked & (follows >= 0xD0) & (follows <= 0xD7)
    keep = np.ones(len(raw), bool)
    keep[:-1][restart] = False
    keep[1:][restart | (marked & (follows == 0))] = False
    keep[-1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    scan_begin = np.concatenate([[0], np.cumsum([len(s) for s in scans])[:-1]])
    begins = np.sort(np.concatenate([scan_begin, np.flatnonzero(restart) + 2]))
    totals = np.array([i.across * i.down for _, i in images])
    every = images[0][1].restart
    lanes = -(-totals // every) if every else np.ones(len(totals), np.int64)
    if lanes.sum() != len(begins):
        raise ValueError("restart markers are missing")
    mcus = np.full(len(begins), every or 0)
    mcus[np.cumsum(lanes) - 1] = totals - (lanes - 1) * every if every else totals
    units = images[0][1].units
    values = _scan_dc(raw[keep], place[begins], mcus, units)
    own = [v for v, (k, _, _) in zip(values, units) if k == 0]
    filled = np.arange(own[0].shape[1])[None, :] < mcus[:, None]
    flat, out, at = [v[filled] for v in own], [], 0
    (h, v), (_, first) = images[0][1].luma, images[0]
    for (_, image), n in zip(images, totals):
        blocks = np.stack([f[at : at + n] for f in flat]).reshape(v, h, image.down, image.across)
        at += n
        grid = blocks.transpose(2, 0, 3, 1).reshape(image.down * v, image.across * h)
        grey = np.clip(np.rint(grid * image.scale / 8 + 128), 0, 255).astype(np.uint8)
        out.append(grey[: -(-image.height * v // (8 * image.most[1])), : -(-image.width * h // (8 * image.most[0]))])
    return out


def thumbnails_of(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each media value, the width, height and thumbnail of each of its images."""
    groups: dict = {}
    out: list[list] = []
    for i, data in enumerate(media):
        at, own = 0, []
        while at < len(data):
            image = _Image(data, at)
            groups.setdefault((image.units, image.restart, image.luma, image.most), []).append((data, image, i, len(own)))
            own.append((image.width, image.height, None))
            at = image.after
        if not own:
            raise ValueError("no image")
        out.append(own)
    for group in groups.values():
        for (_, image, i, k), grey in zip(group, _decode_group([(d, x) for d, x, _, _ in group])):
            out[i][k] = (image.width, image.height, grey)
    return out


def hashes(grey: np.ndarray) -> tuple[str, str]:
    """Average and difference hash of the means of 8 x 9 cells of a thumbnail, 16 hex digits each."""
    rows, across = np.arange(8) * grey.shape[0] // 8, np.arange(9) * grey.shape[1] // 9
    sums = np.add.reduceat(np.add.reduceat(grey.astype(np.int64), rows, axis=0), across, axis=1)
    high, wide = (np.maximum(1, np.diff(x, append=n)) for x, n in zip((rows, across), grey.shape))
    # means as whole numbers, all times the same factor
    small = sums * (np.lcm.reduce(high) // high)[:, None] * (np.lcm.reduce(wide) // wide)
    above = small[:, :8] * 64 > small[:, :8].sum()
    rising = small[:, 1:] > small[:, :-1]
    return tuple(np.packbits(x).tobytes().hex() for x in (above, rising))


def feature(images: list[tuple[int, int, np.ndarray]]) -> str:
    return ";".join(f"{w}x{h}:a{a}:d{d}" for w, h, grey in images for a, d in [hashes(grey)])


# -- DataFrames ---------------------------------------------------------------------------------------------
def _portions(values: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for v in values:
        held.append(v)
        size += len(v)
        if size >= _AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _kinds(df: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep)


def media_of_texts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_bytes (of the text in UTF-8) and media: its bytes, padded to rows of 64, as JPEG."""
    small_batches(df.sparkSession)
    narrow = df.select(*keep, text_or_empty(df, text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [t.encode() for t in batch.column(batch.num_columns - 1).to_pylist()]
            payloads = [p + bytes(-len(p) % COLUMNS or (0 if p else COLUMNS)) for p in plain]
            media = [m for part in _portions(payloads) for m in encode_payloads(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(p) for p in plain], pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return narrow.mapInArrow(run, f"{_kinds(df, keep)}n_bytes long, media binary")


def stored(media: DataFrame) -> DataFrame:
    """The media written as a table in the shared folder, and that table: what is read next comes from its files. Codes of
    whole bits still repeat, so Parquet compresses them by zstandard."""
    path = fresh_path(media.sparkSession, "media")
    media.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(path)
    return media.sparkSession.read.schema(media.schema).parquet(path)


def media_features(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """What the media column, read back, holds: payload digests, its own digest, and the thumbnails' feature."""
    small_batches(df.sparkSession)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for media in _portions(batch.column(batch.num_columns - 1).to_pylist()):
                for data, images in zip(media, thumbnails_of(media)):
                    payload = b"".join(grey.tobytes() for _, _, grey in images)
                    row = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-COLUMNS:]), len(data), hashlib.sha256(data).hexdigest(), feature(images)
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(out, kinds))], names=[*keep, *names])

    return df.select(*keep, "media").mapInArrow(run, f"{_kinds(df, keep)}payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def thumbnails(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For any column of baseline JPEGs: width, height, thumbnail (bytes, row by row) and feature of the first image."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for data in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    images = thumbnails_of([data or b""])[0]
                    row = images[0][0], images[0][1], images[0][2].tobytes(), feature(images)
                except (ValueError, KeyError, IndexError, struct.error):
                    row = None, None, None, None
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(out, kinds))], names=[*keep, "width", "height", "thumbnail", "feature"])

    return df.select(*keep, media).mapInArrow(run, f"{_kinds(df, keep)}width int, height int, thumbnail binary, feature string")
