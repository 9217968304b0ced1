"""Removing repeated passages: every byte that a 50-byte string of an earlier document covers.

The suffixes that matter are those that share their first 50 bytes with one in another
document. They are found block by block, in bounded memory:

1. A cover of the suffixes is sampled: in each 50-byte string the 20-byte string of the
   smallest hash. Equal strings have equal samples at equal places, so a string can only
   repeat where its sample occurs twice. Samples are dealt into buckets by a shortened hash
   and each bucket is sorted by itself; two unlike samples that meet by chance only make
   more candidates.
2. Suffixes whose sample repeats are dealt into buckets by that sample, as stretches of
   text. One bucket at a time, the samples' bytes are sorted and ranked, and the suffixes
   are sorted by that rank, the place of the sample in them and their other 30 bytes. So
   the 20 bytes that all candidates tie in are settled by a rank made before, the rest by
   the bytes themselves: suffixes count as equal only if all 50 bytes are.

A fixed difference cover of period 31 would sample six suffixes in 31; the sample chosen by
content is about one in 16 and needs no alignment between documents. Whatever repeats within
one task's block is resolved there, so a passage held by any share of all documents sends
each bucket no more than one stretch a block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.common import may_hold, text_or_empty, with_group, written

LENGTH, SAMPLE = 50, 20
SPAN = LENGTH - SAMPLE + 1
#: Bytes of text that are hashed at once; entries that a task settles and deals out at once, and that a bucket gets on average.
BLOCK, DEAL, BUCKET = 1 << 20, 1 << 20, 1 << 20
#: Bytes of text that a task holds for one deal.
HELD = 16 << 20
#: Partitions that buckets are spread over at most; further buckets share one, and are still sorted one at a time.
PARTITIONS = 20_000

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, for every place in a block."""
    inverse = pow(_ODD, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, base in ((up, _ODD), (down, inverse)):
        out[0], size, step = 1, 1, base
        while size < n:
            more = min(size, n - size)
            out[size : size + more] = out[:more] * np.uint64(step)
            size, step = size + more, step * step & _MASK
    return up, down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class _Hashes:
    """Rolling hashes of one block: of its 20-byte strings, the smallest in each 50 bytes, and of 50-byte strings."""

    def __init__(self, data: np.ndarray, block: int) -> None:
        up, self._down = _powers(block + LENGTH)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sums[1:])
        self.short = self._of(np.arange(len(data) - SAMPLE + 1), SAMPLE)
        low, width = self.short, 1
        while 2 * width <= SPAN:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        rest = SPAN - width
        self.low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low

    def _of(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self._sums[at + length] - self._sums[at]) * self._down[at])

    def whole(self, at: np.ndarray) -> np.ndarray:
        """The hashes of the 50-byte strings that start at ``at``."""
        return self._of(at, LENGTH)


def _pieces(texts: Iterator[tuple], block: int) -> Iterator[tuple]:
    """(row, doc, data, start, extra): documents in pieces that fit a block, overlapping so that every suffix is whole in one."""
    for row, doc, data, extra in texts:
        for start in range(0, max(1, len(data) - LENGTH + 1), block):
            piece = data[start : start + block + LENGTH - 1]
            if len(piece) >= LENGTH:
                yield row, doc, piece, start, extra


def _blocks(texts: Iterator[tuple], block: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for piece in _pieces(texts, block):
        if held and size + len(piece[2]) > block:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        yield held


def _runs(block: list[tuple], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places (in the block), lengths and pieces of the runs of suffixes that share a sample."""
    lengths = np.array([len(p[2]) for p in block])
    first = np.cumsum(lengths) - lengths
    low = hashes.low
    change = np.concatenate([[True], low[1:] != low[:-1]])
    change[first] = True
    ends = first + lengths - LENGTH + 1  # suffixes from here on reach into the next piece
    change[ends[:-1]] = True
    at = np.flatnonzero(change)
    piece = np.searchsorted(first, at, "right") - 1
    size = np.diff(at, append=len(low))
    inside = at < ends[piece]
    return at[inside], size[inside], piece[inside]


def _shortened(samples: np.ndarray, bits: int) -> np.ndarray:
    return _mixed(samples) >> np.uint64(64 - bits)


def _bucket_of(values: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Buckets are ranges of the shortened hashes."""
    return ((values >> np.uint64(max(0, bits - 32))) * np.uint64(n) >> np.uint64(min(32, bits))).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """Differences without sign, byte plane by byte plane, compressed; planes of noughts take next to nothing."""
    d = np.diff(x.astype(np.int64), prepend=0)
    d = (d << 1) ^ (d >> 63)
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    d = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum((d >> np.uint64(1)).view(np.int64) ^ -(d & np.uint64(1)).view(np.int64))


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for a, b in zip(at, [*at[1:], len(bucket)]):
        yield int(bucket[a]), int(a), int(b)


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, .. of each run, run after run."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row, doc, bytes, samples) from batches of row, doc, text and perhaps samples."""
    for b in batches:
        for i, (row, doc) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            yield row, doc, bytes(b.column(2)[i].as_buffer()), None if b.num_columns < 4 else b.column(3)[i].values.to_numpy(zero_copy_only=False)


_SAMPLE_ROWS = "bucket int, samples binary, rows binary"
_SAMPLES = pa.schema([("bucket", pa.int32()), ("samples", pa.binary()), ("rows", pa.binary())])


def _sampled(rows: DataFrame, n_buckets: int, bits: int) -> DataFrame:
    """Step 1, map side: each block's samples by bucket; those that repeat in the block go to buckets from ``n_buckets`` on, as settled."""
    block_size, deal = BLOCK, DEAL

    def block_samples(block: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        hashes = _Hashes(np.frombuffer(b"".join(p[2] for p in block), np.uint8), block_size)
        at, _, piece = _runs(block, hashes)
        return _shortened(hashes.low[at], bits), np.array([p[0] for p in block], np.int64)[piece]

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        s, r = map(np.concatenate, zip(*held))
        order = np.argsort(s, kind="stable")  # a row's entries stay together
        s, r = s[order], r[order]
        fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
        s, r = s[fresh], r[fresh]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        group = np.cumsum(new) - 1
        shared = np.bincount(group)[group] > 1
        # Settled ones are told to their bucket by one entry with row 0 and answered apart.
        told = ~shared | new
        out = []
        for keep, row, base in ((told, np.where(shared, 0, r), 0), (shared, r, n_buckets)):
            bucket, v, w = _bucket_of(s[keep], bits, n_buckets) + base, s[keep], row[keep]
            out += [(k, _packed(v[a:b]), _packed(w[a:b])) for k, a, b in _cuts(bucket)]
        return _batch(out, _SAMPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in _blocks(_texts(batches), block_size):
            held.append(block_samples(block))
            n += len(held[-1][0])
            if n >= deal:
                yield dealt(held)
                held, n = [], 0
        if held:
            yield dealt(held)

    return rows.select("short", "place", "text").mapInArrow(run, _SAMPLE_ROWS)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Sorted rows -> one bucket at a time."""
    held, last = [], None
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if last is not None and r[0] != last:
                yield last, held
                held = []
            last = r[0]
            held.append(r[1:])
    if held:
        yield last, held


def _in_buckets(entries: DataFrame, n_buckets: int, run, schema: str) -> DataFrame:
    return entries.repartition(min(n_buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _repeated_samples(entries: DataFrame, n_buckets: int) -> DataFrame:
    """Step 1, bucket side: ``short, sample`` of samples that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in _by_bucket(batches):
            s = np.concatenate([_unpacked(p[0]) for p in parts])
            r = np.concatenate([_unpacked(p[1]) for p in parts])
            if bucket < n_buckets:
                order = np.argsort(s, kind="stable")
                s, r = s[order], r[order]
                group = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])) - 1
                repeats = (np.bincount(group)[group] > 1) & (r != 0)
                s, r = s[repeats], r[repeats]
            for at in range(0, len(s), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(r[at : at + 100_000]), pa.array(s[at : at + 100_000])], ["short", "sample"])

    return _in_buckets(entries, n_buckets, run, "short long, sample long")


_STRETCH_ROWS = "bucket int, docs binary, rows binary, places binary, sizes binary, anchors binary, text binary"
_STRETCHES = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("docs", "rows", "places", "sizes", "anchors", "text"))])


class _Deal:
    """Candidate suffixes of some blocks: for each its place in ``data``, its sample's place there, its sample, piece and hash."""

    def __init__(self) -> None:
        self.blocks: list[bytes] = []
        self.parts: list[tuple] = []
        self.owners: list[tuple[int, int, int]] = []
        self.n = self.held = 0

    def add(self, block: list[tuple], block_size: int, bits: int) -> None:
        text = b"".join(p[2] for p in block)
        hashes = _Hashes(np.frombuffer(text, np.uint8), block_size)
        at, size, piece = _runs(block, hashes)
        value = _shortened(hashes.low[at], bits)
        wanted = np.zeros(len(at), bool)
        ends = np.searchsorted(piece, np.arange(len(block) + 1))
        for i, p in enumerate(block):
            wanted[ends[i] : ends[i + 1]] = np.isin(value[ends[i] : ends[i + 1]], p[4].view(np.uint64))
        if not wanted.any():
            return
        at, size, piece, value = at[wanted], size[wanted], piece[wanted], value[wanted]
        start = _ragged(at, size)
        anchor = np.repeat(_first_low(hashes, at), size)
        passed = anchor < start  # text with a period: the same sample comes again
        anchor[passed] = _first_low(hashes, start[passed])
        # First places of pieces, so that a place in the block becomes one in the document.
        first = np.cumsum([0, *(len(p[2]) for p in block)])
        self.parts.append((start + self.held, anchor + self.held, np.repeat(value, size), np.repeat(piece + len(self.owners), size), hashes.whole(start)))
        self.owners += [(p[1], p[0], p[3] - self.held - int(first[i])) for i, p in enumerate(block)]
        self.blocks.append(text)
        self.held += len(text)
        self.n += len(start)

    def rows(self, n_buckets: int, bits: int) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(self.blocks), np.uint8)
        start, anchor, value, piece, key = map(np.concatenate, zip(*self.parts))
        doc, row, shift = (np.array(c, np.int64)[piece] for c in zip(*self.owners))
        late = _later(_class_order(data, start, key), doc)
        out = []
        # Suffixes that an earlier document of this deal holds too are settled: their runs are told, without text.
        for keep, base in ((~late, 0), (late, n_buckets)):
            s, a = start[keep], anchor[keep]
            if not len(s):
                continue
            new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (a[1:] != a[:-1])]))
            n = np.diff(new, append=len(s))
            bucket = _bucket_of(value[keep][new], bits, n_buckets) + base
            order = np.argsort(bucket, kind="stable")
            first, n = s[new][order], n[order]
            columns = [doc[keep][new][order], row[keep][new][order], first + shift[keep][new][order], n, a[new][order] - first]
            for k, i, j in _cuts(bucket[order]):
                text = b"" if base else data[_ragged(first[i:j], n[i:j] + LENGTH - 1)].tobytes()
                out.append((k, *(_packed(c[i:j]) for c in columns), len(text).to_bytes(4, "little") + pa.compress(text, "zstd", asbytes=True)))
        return _batch(out, _STRETCHES)


def _first_low(hashes: _Hashes, at: np.ndarray) -> np.ndarray:
    """The first place of the sample in each 50-byte string that starts at ``at``."""
    out = np.empty(len(at), np.int64)
    for i in range(0, len(at), 100_000):
        own = at[i : i + 100_000]
        out[i : i + 100_000] = own + (hashes.short[own[:, None] + np.arange(SPAN)] == hashes.low[own][:, None]).argmax(1)
    return out


def _class_order(data: np.ndarray, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal 50-byte strings are neighbours, and where each class begins. Equal hashes are checked against the bytes."""
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    same = np.flatnonzero(~new)
    for i in range(0, len(same), 100_000):
        own = same[i : i + 100_000]
        if (windows[start[order[own]]] != windows[start[order[own - 1]]]).any():  # unlike strings with one hash: by their bytes
            _, name = np.unique(np.ascontiguousarray(windows[start]).view(f"V{LENGTH}").ravel(), return_inverse=True)
            return _class_order(data, start, name)
    return order, new


def _later(classes: tuple[np.ndarray, np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document is in the same class."""
    order, new = classes
    own = doc[order]
    low = np.minimum.reduceat(own, np.flatnonzero(new)) if len(own) else own
    late = np.empty(len(doc), bool)
    late[order] = own > low[np.cumsum(new) - 1]
    return late


def _stretches(rows: DataFrame, n_buckets: int, bits: int) -> DataFrame:
    """Step 2, map side: stretches of suffixes whose sample repeats, by bucket; repeats of an earlier document in the deal are settled."""
    block_size, most, held = BLOCK, DEAL, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = _Deal()
        for block in _blocks(_texts(batches), block_size):
            deal.add(block, block_size, bits)
            if deal.n >= most or deal.held >= held:
                yield deal.rows(n_buckets, bits)
                deal = _Deal()
        if deal.n:
            yield deal.rows(n_buckets, bits)

    return rows.select("row", "place", "text", "samples").mapInArrow(run, _STRETCH_ROWS)


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """The columns of a byte matrix, eight at a time, as numbers in the order of the bytes."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    return list(wide.view(">u8").T.astype(np.uint64))


def _sorted_classes(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of rows given by columns, and where each class of equal rows begins."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
    return order, new


def _late_in_bucket(data: np.ndarray, begin: np.ndarray, n: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix of a bucket's stretches (that begin at ``begin`` in ``data``) whether an earlier document holds its 50 bytes.

    Suffixes are sorted by the rank of their sample, its place and the bytes around it.
    """
    order, new = _sorted_classes(_words(data[(begin + anchor)[:, None] + np.arange(SAMPLE)]))
    rank = np.empty(len(begin), np.int64)
    rank[order] = np.cumsum(new)
    start, owner = _ragged(begin, n), np.repeat(np.arange(len(begin)), n)
    before = (begin + anchor)[owner] - start
    late = np.zeros(len(start), bool)
    by_place = np.argsort(before.astype(np.uint8), kind="stable")
    for place, a, b in _cuts(before[by_place]):
        own = by_place[a:b]
        around = np.concatenate([np.arange(place), np.arange(place + SAMPLE, LENGTH)])
        classes = _sorted_classes([rank[owner[own]].view(np.uint64), *_words(data[start[own][:, None] + around])])
        late[own] = _later(classes, doc[owner[own]])
    return late


def _repeats(entries: DataFrame, n_buckets: int) -> DataFrame:
    """Step 2, bucket side: ``place, row, start, end`` of runs of suffixes that an earlier document holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in _by_bucket(batches):
            doc, row, place, n, anchor = (np.concatenate([_unpacked(p[k]) for p in parts]) for k in range(5))
            if bucket < n_buckets:
                text = b"".join(pa.decompress(p[5][4:], int.from_bytes(p[5][:4], "little"), "zstd", asbytes=True) for p in parts)
                begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
                late = np.flatnonzero(_late_in_bucket(np.frombuffer(text, np.uint8), begin, n, anchor, doc))
                owner = np.repeat(np.arange(len(n)), n)[late]
                at = _ragged(place, n)[late]
                new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
                doc, row, place, n = doc[owner[new]], row[owner[new]], at[new], np.diff(new, append=len(at))
            for i in range(0, len(doc), 100_000):
                own = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[own], row[own], place[own], place[own] + n[own] + LENGTH - 1)], ["place", "row", "start", "end"])

    return _in_buckets(entries, n_buckets, run, "place long, row long, start long, end long")


def _cut(data: bytes, spans: list) -> tuple[int, int, int, str]:
    """``n_bytes, n_removed, n_spans, kept_sha256`` when spans, which may overlap or touch, are removed."""
    sha, at, removed, n = hashlib.sha256(), 0, 0, 0
    end = -1
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if a > end:
            n += 1
            sha.update(data[at:a])
            end = a
        if b > end:
            removed += b - end
            end = b
        at = end
    sha.update(data[at:])
    return len(data), removed, n, sha.hexdigest()


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _summed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            out = [_cut(bytes(b.column(1)[i].as_buffer()), b.column(2)[i].as_py() or []) for i in range(b.num_rows)]
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", text_or_empty().alias("text"), "spans").mapInArrow(run, _RESULT)


def _bits(n: int, spare: int) -> int:
    """Bits of a hash of which one in 2**spare meets another by chance."""
    return min(62, max(8, math.ceil(math.log2(n + 1)) + spare))


def repeats(docs: DataFrame) -> DataFrame:
    """``place, row, start, end``: byte spans of each text that an earlier document holds.

    A row is known by its ``_place()`` and ``_row()``. Spans may overlap. An exact copy of
    an earlier text is one span over all of it.
    """
    rows = docs.select(_row().alias("row"), _place().alias("place"), text_or_empty().alias("text"))
    sizes = written(rows.select("row", "place", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("n")), "sizes")
    total, n_rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits, row_bits = _bits(total, 8), _bits(n_rows, 12)
    n_buckets = max(8, math.ceil(2 * total / SPAN / BUCKET))  # two samples in SPAN + 1 suffixes
    # Exact copies are removed whole and are no one's first source, so the sorting needs only first copies.
    grouped = with_group(sizes.filter(F.col("n") >= LENGTH), "digest", F.col("row"), {"first": ("min", "place")})
    copies = written(grouped.filter("place > first").select("place", "row", "n"), "copies")
    marked = may_hold(rows, "row", copies)
    own = marked.filter("not may_hold").drop("may_hold").unionByName(marked.filter("may_hold").drop("may_hold").join(copies.select("place", "row"), ["place", "row"], "left_anti"))
    # A shortened row, never 0: rows that meet by chance get each other's samples, which only makes more candidates.
    own = own.withColumn("short", F.shiftrightunsigned("row", 64 - row_bits) + 1)
    hits = _repeated_samples(_sampled(own, n_buckets, bits), n_buckets).groupBy("short").agg(F.collect_set("sample").alias("samples"))
    hits = written(hits, "samples")
    likely = may_hold(own, "short", hits).filter("may_hold").drop("may_hold").join(hits, "short")
    wanted = hits.agg(F.coalesce(F.sum(F.size("samples")), F.lit(0))).first()[0] * (SPAN + 1) // 2
    n_buckets = max(8, math.ceil(wanted / BUCKET))
    found = _repeats(_stretches(likely, n_buckets, bits), n_buckets)
    return found.unionByName(copies.select("place", "row", F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))


def _row():
    """A row's own number among those of its doc_id, from its text."""
    return F.xxhash64(F.lit("row"), F.col("doc_id"), text_or_empty())


def _place():
    """The order of documents: by doc_id, null ids last and alike."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs(doc_id, text)``.

    Each byte covered by a 50-byte string that also starts in a document with a smaller
    doc_id is removed; texts are UTF-8, null counts as empty, matches never cross
    documents, and texts below 50 bytes stay. Rows with one doc_id are no source for each
    other; null ids come last. Repeated rows get equal results; other columns are ignored.
    """
    spans = repeats(docs).groupBy("place", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = written(spans, "spans")
    rows = may_hold(docs.select("doc_id", "text", _row().alias("row"), _place().alias("place")), "row", spans)
    cut = rows.filter("may_hold").join(spans, ["place", "row"], "left").select("doc_id", "text", "spans")
    text, none = text_or_empty(), F.lit(0).cast("long")
    as_is = rows.filter("not may_hold").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256")
    )
    return _summed(cut).unionByName(as_is)
