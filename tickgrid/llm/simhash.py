"""SimHash near-duplicate detection.

Fingerprints of 64 bits are taken over word shingles. Fingerprints that differ in
at most two bits agree in at least six of their eight bytes, so every linked pair
shares at least one key made of four bytes at fixed positions. The inverted index
maps such positional keys to fingerprints; candidates tally their equal positional
bytes, need six, and are then verified bit by bit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tickgrid.llm.common import plainly_named, written
from tickgrid.llm.components import connected_components
from tickgrid.llm.near import MARK, fingerprint_entries, marked, near_copies

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: Bytes that fingerprints within MAX_BITS must share.
MIN_BYTES = 8 - MAX_BITS
#: Keys with more fingerprints than this are linked through neighbour values, not pairs.
PAIR_LIMIT = 64

_BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _shingles(data: bytes, words_each: int) -> Iterator[bytes]:
    """Space-joined word shingles, read block by block so that memory stays bounded."""
    tail: list[bytes] = []
    at, n_words = 0, 0
    while at < len(data):
        cut = _SPACE.search(data, min(at + _BLOCK, len(data)))
        end = cut.start() if cut else len(data)
        words = data[at:end].split()
        n_words += len(words)
        words = tail + words
        yield from map(b" ".join, zip(*(words[i:] for i in range(words_each))))
        tail = words[-(words_each - 1) :] if words_each > 1 else []
        at = end + 1
    if 0 < n_words < words_each:
        yield b" ".join(tail)


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text; 0 where there is no word."""
    shingles = _shingles((text or "").encode().lower(), words_each)  # bytes.lower() changes A-Z only
    ones, total = np.zeros(64, np.int64), 0
    while len(h := np.fromiter(map(xxh64_intdigest, islice(shingles, 8192), repeat(SEED)), "<u8")):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])


def _index_keys(fp: str = "fp") -> Column:
    """The six positional keys of a fingerprint: two of its four 16-bit blocks each."""
    block = [F.shiftrightunsigned(F.col(fp), 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.struct(F.lit(k).alias("slot"), F.shiftleft(block[i], 16).bitwiseOR(block[j]).alias("key")) for k, (i, j) in enumerate(combinations(range(4), 2))]
    return F.array(*keys)


def _tally(x: Column) -> Column:
    """How many of the eight positional bytes are equal, given the XOR of a pair."""
    return sum((F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for i in range(8))


def links(prints: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` over distinct ``fp`` whose components are those of all links.

    A key held by up to PAIR_LIMIT fingerprints yields candidate pairs. In a larger
    one the fingerprints are linked through neighbour values instead: two values are
    within two bits exactly if they share a value within one bit of both. Each value
    has 65 such neighbours and no more than 65 fingerprints around it, so a group of
    near copies of any size costs 65 rows a fingerprint and no link is lost.
    """
    entries = prints.select("fp", F.explode(_index_keys()).alias("e")).select("fp", "e.slot", "e.key")
    counts = entries.groupBy("slot", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(entries.join(counts, ["slot", "key"]), "postings")
    small = shared.filter(F.col("n") <= PAIR_LIMIT)
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    pairs = (
        small.alias("a")
        .join(small.alias("b"), (F.col("a.slot") == F.col("b.slot")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (_tally(x) >= MIN_BYTES) & (F.bit_count(x) <= MAX_BITS))
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    bits = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    near = shared.filter(F.col("n") > PAIR_LIMIT).select("fp").distinct().select("fp", F.explode(bits).alias("bit"))
    stars = near.groupBy(F.col("fp").bitwiseXOR(F.col("bit")).alias("middle")).agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    hot = stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u <> v")
    return pairs.unionByName(hot)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over fingerprints that differ in
    at most two bits. Null and empty texts have fingerprint zero, linked like any
    other; a null doc_id is returned but never names a component (null where the whole
    component has none); repeated rows are returned once each; other columns are ignored.
    """
    prints = written(docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long"), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    labels = written(connected_components(links(distinct.select("fp"))), "components")
    grouped = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    grouped = written(grouped, "grouped")
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    of_print = grouped.join(lowest, "component").select("fp", "component_id")
    out = prints.join(of_print, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near copies keeps its smallest doc_id.

    Near copies have a Jaccard similarity of at least 0.8 over five-word shingles; two bits
    of a fingerprint, the bound of ``near_duplicates``, would leave most of them.
    Rows that share a doc_id count as one document. Of a group where no row has a doc_id
    exactly one row stays. Columns are those of ``docs``, whatever those are called.
    """
    return _kept(plainly_named(docs)).toDF(*docs.columns)


def keep_one_by_fingerprints(docs: DataFrame) -> DataFrame:
    """``keep_one`` by SimHash: near copies are alike texts that meet in the index of positional bytes of their fingerprints.

    Fingerprints are over the five-word shingles that likeness is told by. Texts that
    have four bytes of a fingerprint in common are candidates, and their whole sets are compared. Texts
    that are just alike enough differ in about ten bits of 64 and often share too few bytes, so
    this finds fewer of them than ``keep_one``, at a cost that does not go by what unlike texts have in common.
    """
    return _kept(plainly_named(docs), fingerprint_entries).toDF(*docs.columns)


def _kept(docs: DataFrame, index: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    groups = written(near_copies(docs, index), "near-copies")
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    unnamed = written(groups.filter("component_id is null").groupBy("component").agg(F.min("set_id").alias(MARK)).select(MARK), "unnamed")
    if unnamed.isEmpty():
        return named
    rows = marked(docs.filter("doc_id is null")).join(unnamed, MARK, "left_semi")
    return named.unionByName(rows.dropDuplicates([MARK]).select(*docs.columns))
