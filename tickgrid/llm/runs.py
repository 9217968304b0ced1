"""Periodic runs of words: Lyndon arrays under both orders of the alphabet by Baier's grouping, roots extended into runs.

The first phase of Baier's suffix sorter groups suffixes by their longest Lyndon prefix,
so its groups' lengths are the Lyndon array; no suffix array is made. Under one of an
order and its reverse, every run has a Lyndon root that is the longest Lyndon word of each
place where it stands. Such a root, repeated, is extended to both sides by the longest
common extensions of its first two copies; the result is the run, and its period the
smallest one.

A text is worked on by itself and nothing is shuffled. Words that cannot lie in a run of
the asked exponent are ruled out before the grouping, see ``_stretches``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run at least, and copies of its root.
LEAST_WORDS, LEAST_COPIES = 6, 4

#: Times that a stretch of words is cut at its rare words.
CUTS = 30


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place, for symbols 0, 1, .. in their order.

    Groups of places are taken from the highest down. A place of the group at hand ends
    here with its word; the next place to its left that is not done yet has a lower word,
    which takes it in (and any equal ones that follow) and moves its place to a new group right above
    its old one, above the other moved ones of that group if it took in more copies.
    """
    n = len(symbols)
    size = [1] * n
    group = list(symbols)
    members: list[list[int]] = [[] for _ in range(max(symbols, default=-1) + 1)]
    for i, c in enumerate(symbols):
        members[c].append(i)
    lower = list(range(-1, len(members) - 1))
    higher = list(range(1, len(members) + 1))
    higher[-1:] = [-1]
    # Places that are not done, as a linked list; place n is its end and -1 (the last entry) its start.
    left = [*range(-1, n), -1]
    right = [*range(1, n + 1), n, 0]
    at = len(members) - 1
    while at >= 0:
        takers: list[int] = []
        copies: list[int] = []
        last = -1
        word = 0
        for s in members[at]:
            if group[s] != at:
                continue
            word = size[s]
            a, b = left[s], right[s]
            right[a] = b
            left[b] = a
            if a >= 0:
                if a == last:
                    copies[-1] += 1
                else:
                    takers.append(a)
                    copies.append(1)
                    last = a
        members[at] = []
        if takers:
            order = range(len(takers)) if max(copies) == 1 else sorted(range(len(takers)), key=lambda k: -copies[k])
            made: dict[tuple[int, int], int] = {}
            for k in order:
                p, many = takers[k], copies[k]
                old = group[p]
                own = made.get((many, old))
                if own is None:
                    own = made[many, old] = len(members)
                    members.append([])
                    above = higher[old]
                    lower.append(old)
                    higher.append(above)
                    higher[old] = own
                    if above >= 0:
                        lower[above] = own
                members[own].append(p)
                group[p] = own
                size[p] += many * word
        at = lower[at]
    return size


def _extent(symbols: np.ndarray, a: int, b: int) -> int:
    """How many symbols from ``a`` and from ``b`` on are equal; ``a < b``. Steps double, so it costs what it finds."""
    n, step, found = len(symbols), 64, 0
    while b + found < n:
        end = min(step, n - b - found)
        differ = symbols[a + found : a + found + end] != symbols[b + found : b + found + end]
        k = int(differ.argmax())
        if differ[k]:
            return found + k
        found, step = found + end, step * 2
    return found


def _runs(symbols: np.ndarray, least_words: int, least_copies: int) -> set[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs among dense symbols."""
    found = set()
    n = len(symbols)
    flipped = symbols[::-1]
    for own in (symbols, symbols.max() - symbols):
        period = np.array(lyndon_lengths(own.tolist()))
        # A run holds one whole copy of its root less than it has copies, or more, one behind the other.
        root = np.arange(n)
        for k in range(1, least_copies - 1):
            behind = root + k * period[root]
            root, behind = root[behind < n], behind[behind < n]
            root = root[period[behind] == period[root]]
        reached: dict[int, int] = {}  # by period, the end of the last run
        for i, q in zip(root.tolist(), period[root].tolist()):
            if i + 2 * q <= reached.get(q, 0):  # a later copy in that run: two runs of one period share less than a period
                continue
            end = i + q + _extent(symbols, i, i + q)
            start = i - _extent(flipped, n - i - q, n - i) if i else 0
            reached[q] = end
            if end - start >= max(least_words, least_copies * q):
                found.add((start, end - start, q))
    return found


def _stretches(symbols: np.ndarray, least_words: int, least_copies: int) -> Iterator[tuple[int, int]]:
    """Stretches of consecutive places outside which no run lies.

    A run holds each of its words as often as it has whole copies of its root. So a place
    whose word is rarer than that in its stretch is in no run of the stretch, and cuts it;
    what is left is cut again until nothing changes, or CUTS times: what is then left is worked on whole.
    """
    todo = [(0, len(symbols), CUTS)]
    while todo:
        a, b, cuts = todo.pop()
        if b - a < least_words:
            continue
        own = symbols[a:b]
        if b - a < 4096:
            _, own = np.unique(own, return_inverse=True)
        bad = np.flatnonzero(np.bincount(own)[own] < least_copies)
        if not len(bad) or not cuts:
            yield a, b
            continue
        edges = np.concatenate([[-1], bad, [b - a]])
        long = np.flatnonzero(np.diff(edges) > least_words)
        todo += [(a + int(edges[k]) + 1, a + int(edges[k + 1]), cuts - 1) for k in long]


def runs_of(words: list, least_words: int = LEAST_WORDS, least_copies: int = LEAST_COPIES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of each run of a list of words, by start, then period.

    A run is a stretch of smallest period ``q`` that no word beside it extends, of at least
    ``least_words`` words and ``least_copies * q`` words; ``least_copies`` is 2 or more.
    """
    if len(words) < least_words:
        return []
    known: dict = {}
    symbols = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = []
    for a, b in _stretches(symbols, least_words, least_copies):
        _, dense = np.unique(symbols[a:b], return_inverse=True)
        found += [(a + start, length, q) for start, length, q in _runs(dense, least_words, least_copies)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def _per_text(docs: DataFrame, schema: str, rows: Callable[[int | None, list[bytes]], list[tuple]]) -> DataFrame:
    """``rows(doc_id, words)`` of each text of ``docs``, a text at a time."""
    types = docs.sparkSession.createDataFrame([], schema).schema
    kinds = [{"bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in types]
    names = types.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts = [], pc.cast(batch.column(1), pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                # The white space at which bytes are split is the contract's: space and U+0009 to U+000D.
                out += rows(doc_id, (text.as_py() or b"").split())
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_copies: int = LEAST_COPIES) -> DataFrame:
    """``doc_id, start, length, period``: a row for each run of words of each text of ``docs(doc_id, text)``; words are counted from 0.

    Null and empty texts have no runs; repeated rows give theirs each; other columns are ignored.
    """
    return _per_text(docs, "doc_id long, start long, length long, period long", lambda i, words: [(i, *r) for r in runs_of(words, least_words, least_copies)])


def collapse_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_copies: int = LEAST_COPIES) -> DataFrame:
    """``doc_id, text, n_words, n_dropped``: texts with runs cut to their first period, words joined by one space; null texts become empty."""

    def rows(doc_id: int | None, words: list[bytes]) -> list[tuple]:
        kept = collapsed(words, runs_of(words, least_words, least_copies))
        return [(doc_id, b" ".join(kept).decode(), len(words), len(words) - len(kept))]

    return _per_text(docs, "doc_id long, text string, n_words long, n_dropped long", rows)


def echoed(words: list, doc_id: int | None) -> list:
    """The words that op12's contract judges: of one id in ten (by crc32) a beginning is repeated to the end; other texts, and those without an id, are as they are."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    root = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (root * ((n - a) // len(root) + 1))[: n - a]


def digests(docs: DataFrame) -> DataFrame:
    """op12's row for each document: its runs' number, the longest one, and hashes of all runs and of the collapsed text.

    Null and empty texts have no runs and the hashes of nothing; a row without an id keeps
    its words as they are. Repeated rows get a row each.
    """

    def rows(doc_id: int | None, words: list[bytes]) -> list[tuple]:
        words = echoed(words, doc_id)
        runs = runs_of(words)
        start, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        told = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        kept = hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
        return [(doc_id, len(runs), start, length, q, 1000 * length // q if runs else None, told, kept)]

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _per_text(docs, schema, rows)
