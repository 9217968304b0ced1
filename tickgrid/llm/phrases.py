"""Phrases whose words keep company: frequent n-grams by mergeable Misra-Gries summaries, then exact counts and a cut score.

First pass: each task turns its texts into n-grams and deals their counts, by a hash, to
parts. A part's counts are merged into a Misra-Gries summary of as many counters as its
share of all n-grams divided by the threshold, so no n-gram that reaches the threshold is
lost. The summaries' survivors are kept as a bitmap of bounded size.

Second pass: texts are read again; what the bitmap rules out is left, the rest is counted
exactly, by language and words. Hashes only propose: a survivor that stands for several n-grams
costs some counting, and all rows below the threshold go then.

Counts are summed up in a task before they are shuffled, so a very frequent phrase is a row a task.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickgrid.llm.common import SALTS, text_or_empty, written

#: Occurrences from which a phrase counts as frequent, and words of a phrase at most.
THRESHOLD, LONGEST = 10, 3

#: N-grams that a task holds before it deals their counts.
HELD = 1 << 22

#: Text bytes of a part of the first pass. A text has no more n-grams of two and three words than bytes.
PART_BYTES = 1 << 24

#: Bits of the survivors' bitmap at most: 64 MB, whatever the input. Fuller bitmaps cost counting, not results.
MOST_BITS = 1 << 29

#: Bytes of a long text that are split into words at a time.
BLOCK = 1 << 22

_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLDED = bytes.maketrans(string.ascii_uppercase.encode() + _SEPARATORS, string.ascii_lowercase.encode() + b"." * len(_SEPARATORS))


def _blocks(text: bytes) -> Iterator[bytes]:
    """The text in blocks of about BLOCK bytes, cut behind a space or separator."""
    at = 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(c, at, at + BLOCK) for c in (b" ", b"\t", b"."))
        if cut < 0:  # one very long word
            found = [c for c in (text.find(c, at + BLOCK) for c in (b" ", b"\t", b".")) if c >= 0]
            cut = min(found) if found else len(text) - 1
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


class _Words:
    """The texts of one language that a task holds, as numbers of words with a 0 between pieces."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b".": 0}
        self.held: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        """Take a text in; returned are the numbers it took."""
        before, number = len(self.held), self.number
        for block in _blocks(text.translate(_FOLDED)):
            words = block.replace(b".", b" . ").split()
            self.held.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        self.held.append(np.zeros(1, np.int64))
        return sum(map(len, self.held[before:]))

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length up to ``longest`` the distinct n-grams (a row of word numbers each) and how often each stands."""
        line = np.concatenate(self.held)
        # A distinct (n-1)-gram has a number too, so a code is never larger than the line's square.
        code, first = line, np.arange(len(line))
        for n in range(1, longest + 1):
            if n > 1:
                follows = line[n - 1 :]
                code = np.where((code[: len(follows)] > 0) & (follows > 0), code[: len(follows)] * len(self.number) + follows, 0)
            distinct, first, code, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            real = distinct > 0
            at = first[real]
            yield n, np.stack([line[at + k] for k in range(n)], axis=1), count[real]
            code = np.where(real[code], code + 1, 0)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Words]]:
    """Languages with the words of their texts, whenever HELD numbers are reached and at the end. Batches are ``(lang, text as binary)``."""
    own: dict[str, _Words] = {}
    n = 0
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang, text in zip(langs, batch.column(1)):
            n += own.setdefault(lang, _Words()).add(text.as_py() or b"")
            if n >= HELD:
                yield from own.items()
                own, n = {}, 0
    yield from own.items()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), modulo 2**64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _gram_hashes(lang: str, hashes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the language and words of each n-gram."""
    out = np.full(len(grams), _word_hashes([lang.encode()])[0] + np.uint64(grams.shape[1]))
    for k in range(grams.shape[1]):
        out = _mixed(out * np.uint64(3) + hashes[grams[:, k]])
    return out


class MisraGries:
    """A mergeable summary: of all counts added, each estimate is too low by ``error`` at most.

    When there are more than ``capacity`` counters, all are lowered by the value of the one after
    the last to be kept. With a capacity above mass / threshold that error stays below the
    threshold. Should more mass come than planned, so that the next lowering would reach
    the threshold, the capacity is doubled instead: nothing frequent is ever lost.
    """

    def __init__(self, capacity: int, threshold: int) -> None:
        self.capacity, self.threshold, self.error = capacity, threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting >= self.capacity:
            self._merge()

    def _merge(self) -> None:
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[new], np.add.reduceat(counts, new) if len(new) else counts
        while len(self.keys) > self.capacity:
            by = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            if self.error + by >= self.threshold:
                self.capacity *= 2
                continue
            self.error += by
            self.keys, self.counts = self.keys[self.counts > by], self.counts[self.counts > by] - by

    def survivors(self) -> np.ndarray:
        """Keys whose count may reach the threshold; every one that does is among them."""
        self._merge()
        return self.keys[self.counts + self.error >= self.threshold]


def _dealt(texts: DataFrame, n_parts: int) -> DataFrame:
    """First pass, text side: ``part, keys, counts``: a task's counts of 32-bit keys, ones first, the others' counts behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _held(batches):
            hashes = _word_hashes(list(words.number))
            every = [(_gram_hashes(lang, hashes, grams), count) for n, grams, count in words.grams(LONGEST) if n > 1]
            h, count = np.concatenate([h for h, _ in every]), np.concatenate([c for _, c in every])
            part = (h >> np.uint64(32)) % np.uint64(n_parts)
            order = np.lexsort((count, part))
            part, key, count = part[order].astype(np.int64), h[order].astype(np.uint32), count[order]
            edges = np.searchsorted(part, np.arange(n_parts + 1))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                a, b = int(edges[p]), int(edges[p + 1])
                ones = a + int(np.searchsorted(count[a:b], 2))
                row = [pa.array([p], pa.int64()), pa.array([np.sort(key[a:ones]).tobytes() + key[ones:b].tobytes()], pa.binary()), pa.array([count[ones:b].astype(np.uint32).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["part", "keys", "counts"])

    return texts.mapInArrow(run, "part long, keys binary, counts binary")


def _survivors(dealt: DataFrame, n_parts: int, capacity: int, threshold: int, n_bits: int) -> DataFrame:
    """First pass, part side: ``bucket, bits``: the survivors' slots as 32-bit words of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, MisraGries] = {}
        for batch in batches:
            for part, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys, many = np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.uint32)
                count = np.concatenate([np.ones(len(keys) - len(many), np.int64), many.astype(np.int64)])
                own.setdefault(part, MisraGries(capacity, threshold)).add(keys, count)
        for part, summary in own.items():
            slot = np.unique(_slots(np.full(len(found := summary.survivors()), part, np.uint64), found.astype(np.uint64), n_bits))
            for i in range(0, len(slot), 100_000):
                # Spark's buckets begin at 1.
                yield pa.RecordBatch.from_arrays([pa.array(slot[i : i + 100_000].astype(np.int64) + 1)], ["slot"])

    slots = dealt.repartition(n_parts, "part").mapInArrow(run, "slot long")
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def _slots(part: np.ndarray, key: np.ndarray, n_bits: int) -> np.ndarray:
    return _mixed((part << np.uint64(32)) | key) % np.uint64(n_bits)


#: Bits of a bucket of ``bitmap_construct_agg``.
_BUCKET_BITS = 32768


def _bitmap(survivors: DataFrame, n_bits: int) -> np.ndarray:
    """The bitmap on the driver: ``n_bits / 8`` bytes, whatever the input."""
    out = np.zeros((n_bits // _BUCKET_BITS + 2) * _BUCKET_BITS // 8, np.uint8)
    for r in survivors.toLocalIterator():
        at = (r.bucket - 1) * (_BUCKET_BITS // 8)
        out[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


_COUNTED = "lang string, w1 string, w2 string, w3 string, f long"


def _counted(texts: DataFrame, n_parts: int, n_bits: int, bitmap: np.ndarray) -> DataFrame:
    """Second pass: ``lang, w1, w2, w3, f``: counts in a task of words and of n-grams the bitmap lets pass, and of all words where w1 is null."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _held(batches):
            listed = list(words.number)
            hashes, names = _word_hashes(listed), pa.array(listed, pa.binary()).cast(pa.string())
            for n, grams, count in words.grams(LONGEST):
                if n == 1:
                    yield _batch(lang, [pa.nulls(1, pa.string())] * 3, np.array([count.sum()]))
                else:
                    h = _gram_hashes(lang, hashes, grams)
                    slot = _slots((h >> np.uint64(32)) % np.uint64(n_parts), h & np.uint64(0xFFFFFFFF), n_bits)
                    passes = (sent.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    grams, count = grams[passes], count[passes]
                for i in range(0, len(grams), 50_000):
                    own = grams[i : i + 50_000]
                    columns = [names.take(pa.array(own[:, k])) for k in range(n)]
                    yield _batch(lang, columns + [pa.nulls(len(own), pa.string())] * (3 - n), count[i : i + 50_000])

    return texts.mapInArrow(run, _COUNTED)


def _batch(lang: str, words: list[pa.Array], count: np.ndarray) -> pa.RecordBatch:
    langs = pa.array([lang] * len(count), pa.string())
    return pa.RecordBatch.from_arrays([langs, *words, pa.array(count.astype(np.int64))], ["lang", "w1", "w2", "w3", "f"])


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, part_bytes: int = PART_BYTES) -> DataFrame:
    """``lang, w1, w2, w3, f``: exact counts of words and of phrases of two and three words that stand ``threshold`` times or more in a language.

    Missing words are null; the row of a language without any word holds the number of all its
    words. Null languages are ``und``. ``part_bytes`` of text go to a part of the first pass on average, at least a part
    a shuffle partition; a part's summary takes ``part_bytes / threshold`` counters.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().cast("binary").alias("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / part_bytes))
    # More than mass / threshold counters: a part's mass is a n-th of the n-grams, which are fewer than bytes.
    capacity = n_bytes // n_parts // threshold + 1
    # Frequent phrases are a tenth of all n-grams at most and in prose some per cent of them; eight bits for each of those.
    n_bits = min(MOST_BITS, max(1 << 20, 1 << math.ceil(math.log2(n_bytes / 16 + 1))))
    bitmap = _bitmap(_survivors(_dealt(texts, n_parts), n_parts, capacity, threshold, n_bits), n_bits)
    counted = _counted(texts, n_parts, n_bits, bitmap).groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f"))
    return written(counted.filter((F.col("f") >= threshold) | F.col("w1").isNull()), "phrases")


def _looked_up(rows: DataFrame, known: DataFrame, words: list[str], name: str, spread: Column) -> DataFrame:
    """``rows`` with the count of the phrase in ``words`` as ``name``. A word may be in any share of the rows, so the counts are copied to a few salts."""
    n = 16
    keys = known.select("lang", *[F.col(f"w{i + 1}").alias(f"__{i}") for i in range(len(words))], F.col("f").alias(name), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__salt"))
    dealt = rows.withColumn("__salt", F.pmod(spread, F.lit(n)).cast("int")).withColumns({f"__{i}": F.col(w) for i, w in enumerate(words)})
    on = ["lang", "__salt", *[f"__{i}" for i in range(len(words))]]
    return dealt.join(keys, on).drop(*on[1:])


def collocations(docs: DataFrame, most: int = 2000, threshold: int = THRESHOLD, part_bytes: int = PART_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``most`` best phrases of two and three words.

    ``a``, ``l`` and ``r`` count the phrase, its first part and its rest at the cut that
    scores least (``1000000 a a / (l r)`` rounded down; ties: the earliest cut); ``n`` counts the
    language's words. A phrase of two words in one of three that stands at least half as often is left out. Texts
    are split into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. Null texts are empty, null
    languages ``und``; repeated rows count each; no frequent phrase gives no row. Other columns are ignored.
    """
    counts = frequent_phrases(docs, threshold, part_bytes)
    singles, pairs = (counts.filter(c) for c in ("w1 is not null and w2 is null", "w2 is not null and w3 is null"))
    triples = counts.filter("w3 is not null")
    spread = F.xxhash64("w1", "w2", "w3")
    scored = lambda k, left, right: F.struct((1_000_000 * _wide("f") * _wide("f")).alias("top"), (_wide(left) * _wide(right)).alias("bottom"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    two = _looked_up(_looked_up(pairs, singles, ["w1"], "l1", spread), singles, ["w2"], "r1", spread)
    two = two.withColumn("cuts", F.array(scored(1, "l1", "r1")))
    three = _looked_up(_looked_up(triples, singles, ["w1"], "l1", spread), singles, ["w3"], "r2", spread)
    three = _looked_up(_looked_up(three, pairs, ["w2", "w3"], "r1", spread), pairs, ["w1", "w2"], "l2", spread)
    three = three.withColumn("cuts", F.array(scored(1, "l1", "r1"), scored(2, "l2", "r2")))

    inside = F.explode(F.array(F.struct(F.col("w1").alias("a"), F.col("w2").alias("b")), F.struct(F.col("w2").alias("a"), F.col("w3").alias("b"))))
    longer = triples.select("lang", "f", inside.alias("p")).groupBy("lang", F.col("p.a").alias("w1"), F.col("p.b").alias("w2")).agg(F.max("f").alias("longer"))
    two = two.join(longer, ["lang", "w1", "w2"], "left").filter("longer is null or 100 * longer < 50 * f")

    columns = ["lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), "cuts"]
    rows = two.select(*columns).unionByName(three.select(*columns))
    best = F.array_min(F.transform("cuts", lambda c: F.struct(F.call_function("div", c["top"], c["bottom"]).cast("long").alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    rows = rows.select("lang", "phrase", "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of each part first, so that the last ranking sees a bounded number of rows of a language.
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS // 16)))
    part = W.partitionBy("lang", "__salt").orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most).drop("__salt")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    totals = counts.filter("w1 is null").select("lang", F.col("f").alias("n"))
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


ORACLE_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
    p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
    g AS (SELECT lang, k, list_slice(w, j, j + k - 1) AS gram FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS j FROM p, (SELECT unnest([1, 2, 3]) AS k))),
    f AS (SELECT lang, k, gram, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, gram, f AS a FROM f WHERE k > 1 AND f >= 10),
    cuts AS (SELECT c.*, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS score
             FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.gram = list_slice(c.gram, 1, cut) JOIN f y ON y.lang = c.lang AND y.gram = list_slice(c.gram, cut + 1, c.k)),
    s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
    o AS (SELECT lang, unnest([list_slice(gram, 1, 2), list_slice(gram, 2, 3)]) AS gram, a FROM c WHERE k = 3),
    m AS (SELECT lang, gram, max(a) AS longer FROM o GROUP BY ALL),
    kept AS (SELECT s.lang, array_to_string(s.gram, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM s LEFT JOIN m ON m.lang = s.lang AND m.gram = s.gram WHERE longer IS NULL OR 100 * longer < 50 * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
