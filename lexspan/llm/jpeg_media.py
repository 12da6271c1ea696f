"""Texts as media columns: payload bytes kept in baseline JPEGs, read back as luminance thumbnails.

Storing: each payload byte is one 8x8 block of constant luminance, ROW blocks to a row. With a
quantiser of 8 a block's DC coefficient is the byte less 128, so nothing is lost, and the thumbnail at
an eighth of the size is the payload. A JPEG holds at most MAX_ROWS rows of blocks; a longer payload
goes on in further JPEGs behind the first one, so that the memory of a task doesn't grow with a text. Scans have a restart marker every INTERVAL blocks.

Reading: markers are parsed, scans are Huffman-decoded (any baseline tables, components, sampling and
restart intervals; AC coefficients are skipped), and DC terms give the thumbnail. All restart
intervals of a batch of images are decoded side by side in numpy, one symbol of each at a time.

Cases: a null text counts as empty, whose payload is ROW spaces; a null doc_id is kept; repeated rows
each get a row, equal texts equal values; a very long text is worked on JPEG by JPEG; an empty table
gives an empty result; other columns, whatever their names, are ignored; broken media raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW, FILL, INTERVAL = 192, 32, 48
#: Rows of blocks in a JPEG (the format allows 8,191).
MAX_ROWS = 1_024
#: Payload bytes that are encoded or decoded together: a dozen arrays of 8 bytes for each of them.
CHUNK = 1 << 18
#: Rows of an Arrow batch that are turned into Python objects together.
SLICE = 200
#: Fixed values of JPEG: code lengths and symbols of the usual luminance DC table.
DC_BITS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
#: The only AC symbol that is needed here: end of block, in one bit.
AC_BITS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)


def codes(bits: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), given the numbers of codes of each length."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _head(rows: int) -> bytes:
    table = lambda where, bits, symbols: _segment(0xC4, bytes([where, *bits, *symbols]))
    return (b"\xff\xd8" + _segment(0xDB, bytes([0] + [8] * 64)) + _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0))
            + table(0x00, DC_BITS, DC_SYMBOLS) + table(0x10, AC_BITS, AC_SYMBOLS) + _segment(0xDD, struct.pack(">H", INTERVAL)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])))


_DC = codes(DC_BITS, DC_SYMBOLS)
_CODE, _LENGTH = (np.array([_DC[s][i] for s in range(10)], np.int64) for i in (0, 1))
_SIZE = np.array([int(x).bit_length() for x in range(512)], np.int64)


def payload(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes of a text filled up to a positive multiple of ROW, and how many are its own."""
    own = (text or "").encode("utf-8", "surrogatepass")
    return own.ljust(max(ROW, -(-len(own) // ROW) * ROW), bytes([FILL])), len(own)


def _scans(parts: list[bytes]) -> list[bytes]:
    """The entropy-coded scan of each part; all parts at once."""
    value = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) - 128
    # ROW is a multiple of INTERVAL, so intervals never reach over a part's end.
    diff = value.reshape(-1, INTERVAL).copy()
    diff[:, 1:] -= value.reshape(-1, INTERVAL)[:, :-1]
    size = _SIZE[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = _LENGTH[size] + size + 1
    code = ((_CODE[size] << size | extra) << 1).ravel()
    ends = np.cumsum(length, 1)
    n_bytes = -(-ends[:, -1] // 8)
    first = np.cumsum(n_bytes) - n_bytes
    at = (first[:, None] * 8 + ends - length).ravel()
    pad = n_bytes * 8 - ends[:, -1]  # ones fill up the last byte of an interval
    at, length = np.append(at, first * 8 + ends[:, -1]), np.append(length.ravel(), pad)
    word = np.append(code, (1 << pad) - 1) << (24 - (at & 7) - length)
    total = int(n_bytes.sum())
    data = sum(np.bincount((at >> 3) + k, word >> (16 - 8 * k) & 255, total + 3) for k in range(3))[:total].astype(np.uint8)
    # A zero goes behind each 255, and a restart marker between the intervals of a part.
    stuffed = data == 255
    per = np.array([len(p) // INTERVAL for p in parts])
    last = np.cumsum(per) - 1
    marked = np.ones(len(n_bytes), bool)
    marked[last] = False
    place = np.arange(total) + np.cumsum(stuffed) - stuffed + np.repeat(2 * (np.cumsum(marked) - marked), n_bytes)
    out = np.zeros(total + int(stuffed.sum()) + 2 * int(marked.sum()), np.uint8)
    out[place] = data
    end = place[np.cumsum(n_bytes) - 1] + stuffed[np.cumsum(n_bytes) - 1] + 1
    number = np.arange(len(n_bytes)) - np.repeat(np.cumsum(per) - per, per)
    out[end[marked]] = 255
    out[end[marked] + 1] = 0xD0 + number[marked] % 8
    cuts = [0, *end[last].tolist()]
    return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """The JPEGs that keep each payload."""
    most = MAX_ROWS * ROW
    parts = ((i, p[k : k + most]) for i, p in enumerate(payloads) for k in range(0, len(p), most))
    out: list[list[bytes]] = [[] for _ in payloads]
    for held in _in_chunks(parts, lambda r: len(r[1])):
        for (i, p), scan in zip(held, _scans([p for _, p in held]), strict=True):
            out[i] += [_head(len(p) // ROW), scan, b"\xff\xd9"]
    return [b"".join(x) for x in out]


@dataclass
class Image:
    """What a JPEG's markers say, and its scan cut into restart intervals."""

    width: int = 0
    height: int = 0
    quant: dict[int, int] = field(default_factory=dict)
    tables: dict[int, tuple] = field(default_factory=dict)
    #: (id, horizontal and vertical sampling, quantiser, DC table, AC table) of each component.
    parts: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    interval: int = 0
    lanes: list[np.ndarray] = field(default_factory=list)


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """The JPEG at a position, and where it ends."""
    image = Image()
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError(f"no JPEG begins at {at}")
    at += 2
    while True:
        if at + 4 > len(data) or data[at] != 255:
            raise ValueError(f"no marker at {at}")
        marker, (n,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n_codes = sum(body[1:17])
                image.tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n_codes]))
                body = body[17 + n_codes :]
        elif marker == 0xC0:
            image.height, image.width = struct.unpack_from(">HH", body, 1)
            image.parts = [(c, s >> 4, s & 15, q, 0, 0) for c, s, q in (body[k : k + 3] for k in range(6, len(body), 3))]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            (image.interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            image.parts = [(c, h, v, q, chosen[c] >> 4, 16 | chosen[c] & 15) for c, h, v, q, *_ in image.parts]
            break
    scan = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(scan[:-1] == 255)
    follows = scan[ff + 1]
    ends = np.flatnonzero((follows != 0) & (follows & 0xF8 != 0xD0))
    if not len(ends):
        raise ValueError("a scan is cut off")
    end = int(ff[ends[0]])
    ff, follows = ff[: ends[0]], follows[: ends[0]]
    keep = np.ones(end, bool)
    keep[ff + 1] = False
    restarts = ff[follows != 0]
    keep[restarts] = False
    cuts = np.cumsum(keep)[restarts]
    image.lanes = np.split(scan[:end][keep], cuts)
    if data[at + end + 1] != 0xD9:
        raise ValueError("only single scans are read here")
    return image, at + end + 2


def _lookup(table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 where no code begins so."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in codes(*table).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


def dc_terms(images: list[Image]) -> list[np.ndarray]:
    """The DC coefficients of the first component's blocks, in the order of the scan.

    The images must agree in tables, sampling and restart interval.
    """
    first = images[0]
    tables = {k: _lookup(t) for k, t in first.tables.items()}
    order = [i for i, (_, h, v, *_) in enumerate(first.parts) for _ in range(h * v if len(first.parts) > 1 else 1)]
    n_mcu = [_mcus(x)[0] * _mcus(x)[1] for x in images]
    lanes, counts = [], []
    for x, n in zip(images, n_mcu, strict=True):
        each = x.interval or n
        if len(x.lanes) != -(-n // each):
            raise ValueError("restart intervals are missing")
        lanes += x.lanes
        counts += [each] * (n // each) + [n % each] * (n % each > 0)
    sizes = np.array([len(x) for x in lanes])
    data = np.zeros(int(sizes.sum()) + 8, np.int64)
    data[:-8] = np.concatenate(lanes)
    pos, n_left = (np.cumsum(sizes) - sizes) * 8, np.array(counts)
    limit = np.cumsum(sizes) * 8
    window = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    most = int(n_left.max())
    luma = order.count(0)
    out = np.zeros((len(lanes), most * luma), np.int64)
    pred = np.zeros((len(lanes), len(first.parts)), np.int64)

    def peek(rows: np.ndarray) -> np.ndarray:
        p = np.minimum(pos[rows], limit[-1])
        return window[p >> 3] >> (8 - (p & 7)) & 0xFFFF

    def take(rows: np.ndarray, table: int) -> np.ndarray:
        symbol, length = tables[table]
        bits = peek(rows)
        n = length[bits]
        if not n.all():
            raise ValueError("a scan holds no code where one must begin")
        pos[rows] += n
        return symbol[bits]

    for mcu in range(most):
        rows = np.flatnonzero(n_left > mcu)
        k = 0
        for part in order:
            dc, ac = first.parts[part][4:]
            size = take(rows, dc)
            extra = peek(rows) >> (16 - size)
            pos[rows] += size
            pred[rows, part] += np.where((size > 0) & (extra < 1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra)
            if part == 0:
                out[rows, mcu * luma + k] = pred[rows, 0]
                k += 1
            busy, place = rows, np.ones(len(rows), np.int64)
            while len(busy):
                rs = take(busy, ac)
                run, size = rs >> 4, rs & 15
                pos[busy] += size
                place = place + run + 1
                go = (rs != 0) & (place < 64)
                busy, place = busy[go], place[go]
    if (pos > limit).any():
        raise ValueError("a scan is too short")
    ends = list(accumulate(len(x.lanes) for x in images))
    return [np.concatenate([out[i, : counts[i] * luma] for i in range(e - len(x.lanes), e)]) if x.interval == 0 or counts[e - 1] != x.interval
            else out[e - len(x.lanes) : e, : x.interval * luma].ravel() for x, e in zip(images, ends, strict=True)]


def _mcus(image: Image) -> tuple[int, int]:
    """How many coded units lie across and down."""
    several = len(image.parts) > 1
    h, v = (max(p[k] for p in image.parts) if several else 1 for k in (1, 2))
    return -(-image.width // (8 * h)), -(-image.height // (8 * v))


def thumbnail(image: Image, dc: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size, from DC terms alone."""
    across, down = _mcus(image)
    _, h, v, q, *_ = image.parts[0]
    if len(image.parts) == 1:
        h = v = 1
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    grid = grid[: -(-image.height // 8), : -(-image.width // 8)]
    return np.clip((grid * image.quant[q] + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def images(media: bytes) -> Iterator[Image]:
    """The JPEGs that stand one behind the other."""
    at = 0
    while at < len(media):
        image, at = parse(media, at)
        yield image


def thumbnails(media: Iterable[bytes]) -> Iterator[tuple[int, Image, np.ndarray]]:
    """(which of the media, image, thumbnail) in order; no more than CHUNK bytes of scans at a time."""
    found = ((i, image) for i, data in enumerate(media) for image in images(data))
    for held in _in_chunks(found, lambda r: sum(map(len, r[1].lanes))):
        groups: dict[tuple, list[Image]] = {}
        for _, x in held:
            groups.setdefault((tuple(sorted(x.tables.items())), tuple(x.parts), x.interval), []).append(x)
        thumbs = {id(x): thumbnail(x, dc) for same in groups.values() for x, dc in zip(same, dc_terms(same), strict=True)}
        yield from ((i, x, thumbs[id(x)]) for i, x in held)


def decode(media: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """The images of each of the media with their thumbnails."""
    out: list[list[tuple[Image, np.ndarray]]] = [[] for _ in media]
    for i, image, thumb in thumbnails(media):
        out[i].append((image, thumb))
    return out


def _bands(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of `parts` parts of n begins, and how many it has; parts share some where n is smaller."""
    edges = np.arange(parts) * n // parts
    return edges, np.maximum(np.diff(np.append(edges, n)), 1)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: in 8 bands of rows, whether each of 9 columns' means is above the one to its left."""
    (top, high), (left, wide) = _bands(thumb.shape[0], 8), _bands(thumb.shape[1], 9)
    sums = np.add.reduceat(np.add.reduceat(thumb, top, axis=0, dtype=np.int64), left, axis=1)
    return np.packbits(np.diff(sums / high[:, None] / wide, axis=1) > 0).tobytes().hex()


def _in_chunks(rows: Iterable[tuple], size: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    """Rows in lists of CHUNK bytes or, where a single row has more, of this row."""
    held, n = [], 0
    for row in rows:
        own = size(row)
        if held and n + own > CHUNK:
            yield held
            held, n = [], 0
        held.append(row)
        n += own
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield from zip(*[c.to_pylist() for c in b.slice(i, SLICE).columns], strict=True)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _in_chunks(((d, *payload(t)) for d, t in _rows(batches)), lambda r: len(r[1])):
        media = encode([p for _, p, _ in held])
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in held], pa.int64()), pa.array([r[2] for r in held], pa.int64()), pa.array(media, pa.binary())],
            ["doc_id", "n_bytes", "media"])


FEATURES = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "width": pa.int32(), "height": pa.int32()}


class _Digest:
    """What is known of one of the media after its images so far."""

    def __init__(self):
        self.sha, self.tail, self.n, self.features, self.width, self.height = hashlib.sha256(), b"", 0, [], 0, 0

    def add(self, image: Image, thumb: np.ndarray) -> None:
        data = thumb.tobytes()
        self.sha.update(data)
        self.tail = (self.tail + data[-16:])[-16:]
        self.n += len(data)
        self.features.append(f"{image.width}x{image.height}:{thumbnail_hash(thumb)}")
        self.width, self.height = max(self.width, image.width), self.height + image.height


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _in_chunks(_rows(batches), lambda r: len(r[2])):
        found = [_Digest() for _ in held]
        for i, image, thumb in thumbnails(m for *_, m in held):
            found[i].add(image, thumb)
        out = [(doc, n, x.n, x.sha.hexdigest(), zlib.crc32(x.tail), len(media), hashlib.sha256(media).hexdigest(), ",".join(x.features), x.width, x.height)
               for (doc, n, media), x in zip(held, found, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), FEATURES.values(), strict=True)], list(FEATURES))


MEDIA = "doc_id long, n_bytes long, media binary"
_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
FEATURES_DDL = ", ".join(f"{k} {_KINDS[v]}" for k, v in FEATURES.items())


def media_columns(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a column of baseline JPEGs."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """What is read back from the media: sizes, digests, dimensions and thumbnail hashes."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES_DDL)


def stored_features(documents: DataFrame) -> DataFrame:
    """media_features(media_columns(documents)), with both steps in one worker for each task."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _features(_store(batches)), FEATURES_DDL)
