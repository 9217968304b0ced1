"""Near copies by exact similarity: Jaccard of word shingles at or above four fifths.

Shingles have one order for all texts, common ones last. Sets that are alike enough share
a shingle among the first fifth of each (prefix filter), and the first one shared leaves
enough after it on both sides. Such pairs are candidates. Of each set the parity of its
shingles in at least SIGNATURE_BITS slots is kept: two sets differ in at least as many shingles as
slots, so most candidates that merely share a passage are ruled out by that, and only the
rest have their whole sets compared. No pair is lost, whatever the order, so common
shingles may be told from a sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from tickgrid.llm.common import may_hold, written
from tickgrid.llm.components import connected_components

SEED = 42
MARK = "__set"
WORDS_EACH = 5
#: Sets are near copies when PARTS_ALIKE of PARTS of their union is shared.
PARTS_ALIKE, PARTS = 4, 5
#: Shingles held by more sets than this are linked through one set first; no link depends on it.
PAIR_LIMIT = 64
#: Sets outside the largest component of a shingle up to which they are compared with all sets of it; no link depends on it.
#: Up to a few thousand such tests of sizes and places cost a set less than to shuffle its part keys.
UNLIKE_LIMIT = 4096
#: Differences that one part of two alike sets has at most, see ``part_keys``.
PART_DIFFERENCES = 5
#: The fewest slots of a set's signature; a larger set has the next power of two not below its size.
SIGNATURE_BITS = 1024
#: Texts from which common shingles are told, in how many of them those are, and how many are ordered last.
SAMPLE, COMMON, LAST = 4_000, 8, 200_000


def grams(text: str | None) -> np.ndarray:
    """The distinct shingles of one text as sorted hashes; one for fewer words than a shingle has."""
    from tickgrid.llm.simhash import _shingles

    found = np.fromiter(map(xxh64_intdigest, _shingles((text or "").encode().lower(), WORDS_EACH), repeat(SEED)), np.uint64)
    return np.unique(found.view(np.int64)) if len(found) else np.array([xxh64_intdigest(b"", SEED)], np.uint64).view(np.int64)


def _set_id(own: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def signature(own: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles in each slot, as numbers of 64 bits; about as many slots as shingles."""
    slots = max(SIGNATURE_BITS, 1 << (len(own) - 1).bit_length())
    odd = np.bincount(own.view(np.uint64) % np.uint64(slots), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [grams(t.as_py()) for t in batch.column(1)]
        columns = [pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "set_id", "n", "signature"])


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` with the set id of each text, the same for equal sets of shingles, in the column MARK."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([_set_id(grams(t.as_py())) for t in batch.column(place)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, MARK])

    return docs.mapInArrow(run, StructType(docs.schema.fields + [StructField(MARK, LongType())]))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            sets = [grams(t.as_py()) for t in batch.column(0).slice(at, 200)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["set_id", "grams"])


def _common(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a bounded sample, sorted, with their counts there."""
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(n)) < SAMPLE) if n > SAMPLE else docs.select("text")
    counts = some.mapInArrow(_whole, "set_id long, grams array<long>").select(F.explode("grams").alias("token")).groupBy("token").count()
    rows = counts.filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(LAST).toArrow()
    token, count = (rows.column(c).to_numpy() for c in ("token", "count"))
    order = np.argsort(token)
    return token[order], count[order]


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: one more than near copies may differ in."""
    weight = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        weight = np.where(common[at] == own, rank[at], 0)
    return own[np.lexsort((own, weight))][: len(own) + 1 + (-PARTS_ALIKE * len(own)) // PARTS]


def _entries(docs: DataFrame, n: int) -> DataFrame:
    """``token, set_id, n, at``: prefix shingles with their set, its size and the place in its order."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                sets = [grams(t.as_py()) for t in batch.column(0).slice(at, 200)]
                first = [prefix(s, *common.value) for s in sets]
                each = [len(p) for p in first]
                columns = [np.concatenate(first), np.repeat([_set_id(s) for s in sets], each), np.repeat([len(s) for s in sets], each), np.concatenate([np.arange(k) for k in each])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32, np.int32))], ["token", "set_id", "n", "at"])

    return docs.select("text").mapInArrow(run, "token long, set_id long, n int, at int")


#: Fingerprints of a set in ``fingerprint_entries``, bytes of one that alike sets must share to meet, and what a further fingerprint turns the hashes by.
FINGERPRINTS, EQUAL_BYTES, TURN = 2, 4, np.uint64(0x9E3779B97F4A7C15)
_KEYS = np.array(list(combinations(range(8), EQUAL_BYTES)))


def fingerprint_keys(own: np.ndarray) -> np.ndarray:
    """Positional keys of a set's SimHash fingerprints: what each choice of EQUAL_BYTES of the eight bytes holds."""
    found, hashes = [], own.view(np.uint64)
    for k in range(FINGERPRINTS):
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        held = np.packbits(2 * ones > len(hashes), bitorder="little")[_KEYS].astype(np.uint64)
        value = (held << (np.arange(EQUAL_BYTES, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)
        found.append(value | (np.uint64(k * len(_KEYS)) + np.arange(len(_KEYS), dtype=np.uint64)) << np.uint64(32))
        hashes = (hashes ^ (hashes >> np.uint64(29))) * TURN
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = hashes ^ (hashes >> np.uint64(31))
    return np.concatenate(found).view(np.int64)


def fingerprint_entries(docs: DataFrame, n: int) -> DataFrame:
    """``token, set_id, n, at``: positional keys of each text's fingerprints, an inverted index of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                sets = [grams(t.as_py()) for t in batch.column(0).slice(at, 200)]
                keys = [fingerprint_keys(s) for s in sets]
                each = len(keys[0])
                columns = [np.concatenate(keys), np.repeat([_set_id(s) for s in sets], each), np.repeat([len(s) for s in sets], each), np.zeros(each * len(sets))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32, np.int32))], ["token", "set_id", "n", "at"])

    return docs.select("text").mapInArrow(run, "token long, set_id long, n int, at int")


def _size_classes(n: int) -> list[int]:
    """The largest sizes of the classes in which a set of ``n`` shingles may meet an alike one: by the larger set of a pair."""
    top, found = 1, []
    while True:
        if top >= n:
            found.append(top)
        if PARTS_ALIKE * top >= PARTS * n:
            return found
        top = max(top + 1, PARTS * top // PARTS_ALIKE)


def part_keys(own: np.ndarray) -> np.ndarray:
    """Keys of one set such that any two sets that are alike enough have one in common.

    Alike sets of at most ``top`` shingles differ in at most ``d`` = 2 * top / 9. Shingles are
    dealt by hash to so many parts that one has at most PART_DIFFERENCES differences, and in
    a part to two sub-parts more than that, so two sub-parts are the same in both sets: a key
    is what two sub-parts of a part hold, about 0.8 keys a shingle. Sets that merely share a
    passage rarely hold it, and nothing else, in two sub-parts.
    """
    values, keys = own.view(np.uint64), []
    mixed = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    for top in _size_classes(len(own)):
        d = 2 * (PARTS - PARTS_ALIKE) * top // (PARTS + PARTS_ALIKE)
        least = min(PART_DIFFERENCES, d)
        parts, subs = d // (least + 1) + 1, least + 2
        held = np.zeros(parts * subs, np.uint64)
        np.add.at(held, values % np.uint64(parts * subs), mixed)
        i, j = np.triu_indices(subs, 1)
        held = held.reshape(parts, subs)
        place = np.arange(parts * len(i), dtype=np.uint64).reshape(parts, -1) + (np.uint64(top) << np.uint64(32))
        both = held[:, i] * np.uint64(0x9E3779B97F4A7C15) + held[:, j] * np.uint64(0xC2B2AE3D27D4EB4F) + place * np.uint64(0x165667B19E3779F9)
        keys.append((both ^ (both >> np.uint64(31))).ravel())
    return np.unique(np.concatenate(keys)).view(np.int64)


def _part_entries(docs: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """``token, set_id, n, at, component`` for each key in ``part_keys`` of ``sets(set_id, component)`` that a second set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                own = [grams(t.as_py()) for t in batch.column(0).slice(at, 50)]
                keys = [part_keys(s) for s in own]
                each = [len(k) for k in keys]
                columns = [np.concatenate(keys), np.repeat([_set_id(s) for s in own], each), np.repeat([len(s) for s in own], each), np.zeros(sum(each))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32, np.int32))], ["token", "set_id", "n", "at"])

    rows = may_hold(docs.select("doc_id", "text"), "doc_id", signatures.join(sets, "set_id", "left_semi").select("doc_id")).filter("may_hold")
    entries = may_hold(rows.select("text").mapInArrow(run, "token long, set_id long, n int, at int"), "set_id", sets).filter("may_hold").drop("may_hold")
    counts = written(entries.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1").select("token"), "part-keys")
    repeated = may_hold(entries, "token", counts).filter("may_hold").drop("may_hold").distinct()
    return repeated.join(counts, "token").join(sets, "set_id")


def _may_be_near(a: str, b: str):
    """What sizes and places of a shared shingle allow."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = PARTS * F.least(na, nb) >= PARTS_ALIKE * F.greatest(na, nb)
    return sizes & ((PARTS_ALIKE + PARTS) * F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at")) >= PARTS_ALIKE * (na + nb))


def _pairs(a: DataFrame, b: DataFrame, further) -> DataFrame:
    both = a.alias("a").join(b.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.set_id") != F.col("b.set_id")) & _may_be_near("a", "b") & further)
    return both.select(F.least("a.set_id", "b.set_id").alias("u"), F.greatest("a.set_id", "b.set_id").alias("v")).distinct()


def _may_be_alike(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The ``pairs`` whose signatures allow enough likeness; none that is alike enough is lost.

    Sizes of a pair are so close that one signature is at most twice as long as the other;
    its halves laid over each other are the signature in half the slots.
    """

    def as_short(s: str, other: str):
        half = F.expr(f"size({s}) div 2").cast("int")
        folded = F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(s) > F.size(other), folded).otherwise(F.col(s))

    both = pairs
    for c in "uv":
        both = both.join(signatures.select(F.col("set_id").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}")), c)
    differing = F.aggregate(F.zip_with(as_short("su", "sv"), as_short("sv", "su"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return both.filter((PARTS_ALIKE + PARTS) * differing <= (PARTS - PARTS_ALIKE) * (F.col("nu") + F.col("nv"))).select("u", "v")


def _alike(docs: DataFrame, signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` whose whole sets are alike enough. Only sets of candidates are shuffled."""
    pairs = written(_may_be_alike(pairs, signatures), "candidates")
    wanted = written(pairs.select(F.explode(F.array("u", "v")).alias("set_id")).distinct(), "wanted")
    # One document of each such set is read again; a null id stands for all rows that have none.
    rows = may_hold(docs.select("doc_id", "text"), "doc_id", signatures.join(wanted, "set_id", "left_semi").select("doc_id")).filter("may_hold")
    sets = may_hold(rows.select("text").mapInArrow(_whole, "set_id long, grams array<long>"), "set_id", wanted).filter("may_hold")
    sets = written(sets.select("set_id", "grams").dropDuplicates(["set_id"]), "sets")
    left = pairs.join(sets.select(F.col("set_id").alias("u"), F.col("grams").alias("gu")), "u")
    both = left.join(sets.select(F.col("set_id").alias("v"), F.col("grams").alias("gv")), "v")
    shared = F.size(F.array_intersect("gu", "gv"))
    return written(both.filter((PARTS_ALIKE + PARTS) * shared >= PARTS_ALIKE * (F.size("gu") + F.size("gv"))).select("u", "v"), "alike")


def links(docs: DataFrame, signatures: DataFrame, n: int, index: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Edges ``(u, v)`` over set ids whose components are those of all near copies.

    ``signatures`` has ``set_id, n, signature`` of each set once, with the smallest doc_id of
    its texts. A shingle held by up to PAIR_LIMIT sets yields candidate pairs. In a larger one
    all sets are compared with one of them first, that with the fewest rarer shingles: of
    changed copies of one text it is the least changed, so nearly all others are alike with
    it. Up to UNLIKE_LIMIT sets that are then outside the largest component of the shingle are
    compared with all sets of other components, each pair once. Where more are outside, many
    unlike texts merely share the shingle; the sets of such shingles meet by ``part_keys``
    instead. So a group of near copies of any size costs a few rows a set, a shingle at most
    UNLIKE_LIMIT pairs a set, and no link is lost. With another ``index`` than that of prefix
    shingles, sets meet by its keys; no link between sets that share one is lost. Such keys
    tell no places, by which most pairs of a shingle are ruled out, so there all keys of more
    than two sets are linked through one set first.
    """
    # Prefixes are made twice, which is cheaper than to write or shuffle those that no other set has.
    entries = (index or _entries)(docs, n)
    counts = written(entries.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1"), "held")
    repeated = may_hold(entries, "token", counts).filter("may_hold").drop("may_hold")
    shared = written(repeated.join(counts, "token"), "postings")
    paired = PAIR_LIMIT if index is None else min(PAIR_LIMIT, 2)
    small = shared.filter(F.col("held") <= paired)
    large = shared.filter(F.col("held") > paired)
    hubs = large.groupBy("token").agg(F.min(F.struct("at", "set_id", "n")).alias("hub")).select("token", "hub.*")
    edges = _alike(docs, signatures, _pairs(small, small, F.col("a.set_id") < F.col("b.set_id")).unionByName(_pairs(large, hubs, F.lit(True))).distinct())
    if large.isEmpty():
        return edges
    labels = written(connected_components(edges).withColumnRenamed("node", "set_id"), "first-components")
    placed = large.join(labels, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    placed = _by_component(placed.select("token", "set_id", "n", "at", "component"), "placed")
    pairs = _unlike_pairs(placed.filter(F.col("unlike") <= UNLIKE_LIMIT))
    crowd = placed.filter(F.col("unlike") > UNLIKE_LIMIT)
    if not crowd.isEmpty():
        sets = written(crowd.select("set_id", "component").distinct(), "crowd")
        pairs = pairs.unionByName(_unlike_pairs(_by_component(_part_entries(docs, signatures, sets), "parts"))).distinct()
    return edges.unionByName(_alike(docs, signatures, pairs))


def _by_component(rows: DataFrame, name: str) -> DataFrame:
    """``rows(token, set_id, n, at, component)`` of tokens with two components or more, each with the token's largest component and how many sets are outside it."""
    rows = written(rows, name)
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("k"))
    told = sizes.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), (F.sum("k") - F.max("k")).alias("unlike")).filter("unlike > 0")
    return written(rows.join(told, "token"), name)


def _unlike_pairs(placed: DataFrame) -> DataFrame:
    """Each pair of sets of different components that a token of ``placed`` holds and that sizes and places allow."""
    minor = placed.filter("component <> largest")
    once = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("a.largest")) | (F.col("a.set_id") < F.col("b.set_id")))
    return _pairs(minor, placed, once)


def near_copies(docs: DataFrame, index: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """``doc_id, set_id, component, component_id`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more (null where the whole component has
    none). Null and empty texts are alike; other columns are ignored. ``index`` is that of ``links``.
    """
    marks = written(docs.select("doc_id", "text").mapInArrow(_marks, "doc_id long, set_id long, n int, signature array<long>"), "marks")
    signatures = written(marks.groupBy("set_id").agg(F.min("n").alias("n"), F.min("signature").alias("signature"), F.min("doc_id").alias("doc_id")), "signatures")
    marks = marks.select("doc_id", "set_id")
    labels = written(connected_components(links(docs, signatures, marks.count(), index)).withColumnRenamed("node", "set_id"), "components")
    low = marks.groupBy("set_id").agg(F.min("doc_id").alias("low"))
    grouped = written(low.join(labels, "set_id", "left").select("set_id", "low", F.coalesce("component", "set_id").alias("component")), "grouped")
    lowest = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    return marks.join(grouped.join(lowest, "component").select("set_id", "component", "component_id"), "set_id").select("doc_id", "set_id", "component", "component_id")
