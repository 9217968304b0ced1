"""TIFF media columns: writing texts as pages of 8-bit samples and reading pages back.

The reader walks the chain of image directories in either byte order, decodes PackBits,
LZW or deflate strips and tiles, undoes the horizontal predictor and yields one row per
page. What cannot be read is a row with an error, not a failed job.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a row of an image, and the unit that payloads are filled up to.
WIDTH = 576
#: Rows on a page, rows in a strip, and the side of a tile.
PAGE_ROWS, STRIP_ROWS, TILE = 256, 32, 64
#: Samples of the largest page that is decoded; a larger one is an error.
MAX_SAMPLES = 1 << 28

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

# Tags and sizes of field types (fixed values of the format).
_TAG = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_at": 273, "samples": 277, "strip_rows": 278, "strip_size": 279, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_at": 324, "tile_size": 325}
_NAME = {v: k for k, v in _TAG.items()}
_TYPE = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}


# --- codecs -----------------------------------------------------------------------

_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits(data: bytes) -> bytes:
    """Runs of three and more are repeated bytes; what lies between is literal."""
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        literal(m.start())
        out += bytes((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    literal(len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


_CLEAR, _END = 256, 257


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early."""
    bits = n_bits = 0
    out = bytearray()
    codes: dict[bytes, int] = {}
    width = 9

    def put(code: int) -> None:
        nonlocal bits, n_bits
        bits = bits << width | code
        n_bits += width
        while n_bits >= 8:
            n_bits -= 8
            out.append(bits >> n_bits & 255)
        bits &= (1 << n_bits) - 1

    put(_CLEAR)
    fresh, held = 258, b""
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if len(longer) == 1 or longer in codes:
            held = longer
            continue
        put(codes[held] if len(held) > 1 else held[0])
        codes[longer] = fresh
        fresh += 1
        if fresh == 4095:
            put(_CLEAR)
            codes, fresh, width = {}, 258, 9
        elif fresh in (512, 1024, 2048):
            width += 1
        held = longer[-1:]
    if held:
        put(codes[held] if len(held) > 1 else held[0])
        if fresh + 1 in (512, 1024, 2048):
            width += 1
    put(_END)
    if n_bits:
        out.append(bits << (8 - n_bits) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    table: list[bytes] = []
    out: list[bytes] = []
    bits = n_bits = at = total = 0
    width, last = 9, b""
    while total < size:
        while n_bits < width:
            if at == len(data):
                return b"".join(out)
            bits = bits << 8 | data[at]
            at += 1
            n_bits += 8
        n_bits -= width
        code = bits >> n_bits
        bits &= (1 << n_bits) - 1
        if code == _END:
            break
        if code == _CLEAR:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of its table")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        out.append(entry)
        total += len(entry)
        last = entry
    return b"".join(out)


def _encode(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, LZW: lzw, PACKBITS: packbits, DEFLATE: lambda d: zlib.compress(d, 6)}[compression](data)


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression in (NONE, LZW, PACKBITS):
        return {NONE: lambda d, n: d, LZW: unlzw, PACKBITS: unpackbits}[compression](data, size)
    raise ValueError(f"compression {compression} is not supported")


# --- files ------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How pages are stored: the compression, the horizontal predictor, and strips or tiles."""

    compression: int = DEFLATE
    predictor: bool = False
    tiled: bool = False


def write_tiff(pages: list[np.ndarray], layout: Layout) -> bytes:
    """Pages of unsigned 8-bit samples, in the order given."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        if layout.tiled:
            down, across = -(-height // TILE), -(-width // TILE)
            full = np.zeros((down * TILE, across * TILE), np.uint8)
            full[:height, :width] = page
            blocks = [full[r : r + TILE, c : c + TILE] for r in range(0, down * TILE, TILE) for c in range(0, across * TILE, TILE)]
        else:
            blocks = [page[r : r + STRIP_ROWS] for r in range(0, height, STRIP_ROWS)]
        at, sizes = [], []
        for block in blocks:
            if layout.predictor:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            data = _encode(block.tobytes(), layout.compression)
            at.append(len(out))
            sizes.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)
        fields = {"width": [width], "height": [height], "bits": [8], "compression": [layout.compression], "photometric": [1], "samples": [1], "predictor": [2 if layout.predictor else 1]}
        fields |= {"tile_width": [TILE], "tile_height": [TILE], "tile_at": at, "tile_size": sizes} if layout.tiled else {"strip_at": at, "strip_rows": [STRIP_ROWS], "strip_size": sizes}
        entries = b""
        for name, values in sorted(fields.items(), key=lambda x: _TAG[x[0]]):
            data = struct.pack(f"<{len(values)}I", *values)
            if len(data) > 4:
                place = len(out)
                out += data
                data = struct.pack("<I", place)
            entries += struct.pack("<HHI", _TAG[name], 4, len(values)) + data
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """Per image directory its fields and its samples; directories that repeat end the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF file")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    if not at:
        raise ValueError("no image directory")
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        fields: dict[str, list[int]] = {}
        for e in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack_from(order + "HHI", data, e)
            if tag in _NAME and kind in _TYPE:
                code, size = _TYPE[kind]
                place = e + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
                fields[_NAME[tag]] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        yield fields, _samples(data, fields)


def _samples(data: bytes, fields: dict[str, list[int]]) -> np.ndarray:
    one = lambda name, default=None: fields.get(name, [default])[0]
    width, height, compression = one("width"), one("height"), one("compression", NONE)
    if one("bits", 1) != 8 or one("samples", 1) != 1:
        raise ValueError("only one 8-bit sample for each pixel is supported")
    if not (width > 0 and height > 0 and width * height <= MAX_SAMPLES):
        raise ValueError(f"a page of {width} by {height}")
    tiled = "tile_at" in fields
    w, h = (one("tile_width"), one("tile_height")) if tiled else (width, min(one("strip_rows", height), height))
    if not (w > 0 and h > 0 and w * h <= MAX_SAMPLES):
        raise ValueError(f"a block of {w} by {h}")
    across, down = -(-width // w), -(-height // h)
    places, sizes = (fields[f"{'tile' if tiled else 'strip'}_{x}"] for x in ("at", "size"))
    if min(len(places), len(sizes)) < across * down:
        raise ValueError(f"{min(len(places), len(sizes))} of {across * down} blocks")
    out = np.zeros((height, width), np.uint8)
    for k, (at, size) in enumerate(zip(places[: across * down], sizes)):
        row, col = k // across * h, k % across * w
        rows = h if tiled else min(h, height - row)
        block = np.frombuffer(_decode(data[at : at + size], compression, rows * w), np.uint8, rows * w).reshape(rows, w)
        if one("predictor", 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        part = block[: height - row, : width - col]
        out[row : row + part.shape[0], col : col + part.shape[1]] = part
    return out


# --- Spark ---------------------------------------------------------------------------


def payload(text: str | None) -> bytes:
    """UTF-8 filled up with bytes 255 to a positive multiple of WIDTH."""
    data = (text or "").encode()
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\xff")


def layout_for(data: bytes) -> Layout:
    """By the payload alone: one row LZW, up to eight rows PackBits, else deflate, tiled from 64 rows on, the predictor for those of an odd number of rows."""
    rows = len(data) // WIDTH
    if rows == 1:
        return Layout(LZW)
    if rows <= 8:
        return Layout(PACKBITS)
    return Layout(DEFLATE, predictor=bool(rows % 2), tiled=rows >= 64)


def text_to_tiff(text: str | None) -> bytes:
    data = payload(text)
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return write_tiff([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], layout_for(data))


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text of ``docs(doc_id, text)`` as a TIFF file; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = some.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(map(text_to_tiff, texts), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: What damaged media raise on reading.
_DAMAGE = (ValueError, KeyError, IndexError, TypeError, OverflowError, ZeroDivisionError, struct.error, zlib.error)


def pages_of(data: bytes | None) -> Iterator[tuple[int, dict, np.ndarray | None, str | None]]:
    """``number, fields, samples, error`` per page; reading ends at the first error, which has no samples."""
    k = 0
    try:
        if data is None:
            raise ValueError("no media")
        for fields, samples in read_tiff(data):
            yield k, fields, samples, None
            k += 1
    except _DAMAGE as e:
        yield k, {}, None, f"{type(e).__name__}: {e}"


def read_pages(media: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``media(doc_id, media)`` -> one row per page: its number, size, compression and samples.

    Media that are null, no TIFF file or damaged have a last row with ``error`` and null
    for what could not be read, numbered as the page that failed; the pages before it
    stand. Pages of one row come in order, one after the other. The columns ``keep`` are
    repeated on each page.
    """
    fields = [f for f in media.schema.fields if f.name in keep]
    names = ["doc_id", "page", "width", "height", "compression", "samples", "error"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple], of: list[int], batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)]
            return pa.RecordBatch.from_arrays(columns + [batch.column(c).take(pa.array(of, pa.int64())) for c in kept], names + kept)

        for batch in batches:
            rows, of, size = [], [], 0
            for i, (key, data) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("media"))):
                for k, own, samples, error in pages_of(data.as_py()):
                    if error is None:
                        rows.append((key, k, samples.shape[1], samples.shape[0], own.get("compression", [NONE])[0], samples.tobytes(), None))
                        size += samples.size
                    else:
                        rows.append((key, k, None, None, None, None, error))
                    of.append(i)
                    if size > 8_000_000:
                        yield table(rows, of, batch)
                        rows, of, size = [], [], 0
            yield table(rows, of, batch)

    schema = "doc_id long, page int, width int, height int, compression int, samples binary, error string"
    return media.select("doc_id", "media", *kept).mapInArrow(run, ", ".join([schema, *(f"{f.name} {f.dataType.simpleString()}" for f in fields)]))


def features(counts: np.ndarray, rows: int, pages: int) -> str:
    """Features of an image: its rows and pages, and the mean, spread and entropy of its samples."""
    p = counts / counts.sum()
    values = np.arange(256)
    mean = float(p @ values)
    spread = float(np.sqrt(p @ (values - mean) ** 2))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"rows={rows};pages={pages};mean={mean:.4f};spread={spread:.4f};entropy={entropy:.4f}"


class _Summary:
    """What is told of one stored text, page after page."""

    def __init__(self, row: dict):
        self.own = (row["doc_id"], row["n_bytes"])
        self.stored = (row["media_bytes"], row["media_sha256"])
        self.total = self.rows = self.pages = 0
        self.tail = b""
        self.sha, self.counts = hashlib.sha256(), np.zeros(256, np.int64)

    def add(self, row: dict) -> None:
        if row["error"] is not None:
            raise ValueError(f"page {row['page']} of {row['doc_id']}: {row['error']}")
        samples = row["samples"]
        self.sha.update(samples)
        self.counts += np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
        self.total, self.rows, self.pages, self.tail = self.total + len(samples), self.rows + row["height"], self.pages + 1, samples[-32:]

    def result(self) -> tuple:
        return (*self.own, self.total, self.sha.hexdigest(), zlib.crc32(self.tail), *self.stored, features(self.counts, self.rows, self.pages))


def digests(docs: DataFrame) -> DataFrame:
    """Store every text as TIFF, read the stored bytes back as page rows, and describe what was read.

    One row per row of ``docs(doc_id, text)``; null and empty texts are one row of bytes
    255; equal texts give equal values; other columns are ignored. A page that cannot be
    read back fails the job, since it was stored here. No shuffle: the pages of a text
    come one after the other, the first is number 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

        text: _Summary | None = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["page"] == 0:
                    if text is not None:
                        out.append(text.result())
                    text = _Summary(row)
                text.add(row)
            yield table(out)
        if text is not None:
            yield table([text.result()])

    stored = store(docs).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = read_pages(stored, keep=("n_bytes", "media_bytes", "media_sha256"))
    return pages.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
