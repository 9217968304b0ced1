"""Packing token sequences into fixed-size training sequences.

The number of distinct piece lengths is bounded by the capacity, so the whole corpus
is summed up by one histogram. Over it a configuration linear program (how many
sequences to fill in which way) is solved by multiplicative weights, each round pricing
the best configuration by a knapsack recurrence. A round takes its configuration as often
as the pieces left allow, rounded down, so the answer is whole; what no full configuration
holds is filled best-fit. Pieces then take their places by rank, in Spark.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickgrid.llm.common import written

CAPACITY = 1024
END_OF_TEXT = 2
#: Pieces of one length are ranked in this many groups, so that a very common length is no single task.
RANK_GROUPS = 256
#: Rounds of multiplicative weights at most, how fast the weight of a length falls as it is covered, and how much more a long piece is worth than its tokens.
ROUNDS, RATE, TILT = 4000, 0.1, 0.02

#: Split pattern of the byte-level vocabulary (a fixed value of that public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def byte_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary in a tokenizers file, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: full ones, after a shorter first one where needed."""
    first = n_ids % capacity or min(n_ids, capacity)
    ends = range(first, n_ids + 1, capacity)
    return [(max(0, e - (first if i == 0 else capacity)), first if i == 0 else capacity) for i, e in enumerate(ends)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_OF_TEXT, with_ids: bool = False) -> DataFrame:
    """The pieces of every text, with their ids where asked for. Null counts as empty: one piece, the end id."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_encoding(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encoding.encode(text.as_py() or "", allowed_special="all"), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((key, k, start, length, zlib.crc32(own.tobytes()), *([own.tolist()] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES + ", ids array<int>" * with_ids)


def best_configuration(values: np.ndarray, lengths: np.ndarray, capacity: int) -> Counter:
    """The unbounded knapsack of greatest value, as a count by length (exact, by recurrence over the room)."""
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = values
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        total = worth[1 : room + 1] + best[room - 1 :: -1][:room]
        k = room - 1 - int(total[::-1].argmax())  # of equal ones the longest
        if total[k] > best[room - 1]:
            best[room], choice[room] = total[k], k + 1
        else:
            best[room] = best[room - 1]
    found, room = Counter(), capacity
    while room > 0:
        if choice[room]:
            found[int(choice[room])] += 1
            room -= int(choice[room])
        else:
            room -= 1
    return found


def _priced(weights: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> tuple[Counter, int]:
    """A configuration of great weight that the pieces left allow, and the room it leaves; the knapsack is solved anew for room that a scarce length left."""
    place = {int(n): i for i, n in enumerate(lengths)}
    found, room, left = Counter(), capacity, left.copy()
    while room and (usable := (left > 0) & (lengths <= room) & (weights > 0)).any():
        for length, n in best_configuration(weights[usable], lengths[usable], room).items():
            n = min(n, int(left[place[length]]))
            found[length] += n
            left[place[length]] -= n
            room -= n * length
    return found, room


def solve(histogram: dict[int, int], capacity: int, drop: bool = True, rounds: int = ROUNDS) -> tuple[Counter, dict[int, int]]:
    """Multiplicative weights on the configuration program: full configurations with how often, and the pieces left.

    The weight of a length falls by exp(-RATE) as all its pieces are covered. Where the
    configuration found is not full, its longest length is left for best-fit and the others
    go on (``drop``), or all that is left is best-fit's.
    """
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(n)] for n in lengths], float)
    place = {int(n): i for i, n in enumerate(lengths)}
    left, dropped, plan = need.copy(), np.zeros(len(lengths), bool), Counter()
    for _ in range(rounds):
        weights = np.where((left > 0) & ~dropped, lengths / capacity * (1 + TILT * lengths / capacity) * np.exp(-RATE * (1 - left / need)), 0)
        found, room = _priced(weights, lengths, left, capacity)
        if not found or room and not drop:
            break
        if room:
            dropped[place[max(found)]] = True
            continue
        times = int(min(left[place[k]] // n for k, n in found.items()))
        for k, n in found.items():
            left[place[k]] -= times * n
        plan[tuple(sorted(found.items(), reverse=True))] += times
    return plan, {int(k): int(n) for k, n in zip(lengths, left) if n}


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing on counts: configuration -> times. Equal bins are filled together, whatever their number."""
    open_bins: dict[int, list[list]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(length, capacity) if open_bins[r]), None)
            if room is None:
                each = capacity // length
                for n, times in ((each, left // each), (left % each, 1)):
                    if n and times:
                        open_bins[capacity - n * length].append([{length: n}, times])
                left = 0
                continue
            held, times = open_bins[room].pop()
            used = min(left, times)
            if times > used:
                open_bins[room].append([held, times - used])
            open_bins[room - length].append([held | {length: held.get(length, 0) + 1}, used])
            left -= used
    plan: Counter = Counter()
    for held, times in (b for bins in open_bins.values() for b in bins):
        plan[tuple(sorted(held.items(), reverse=True))] += times
    return plan


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Whole configurations that hold the histogram exactly: the program's, or best-fit where that needs fewer."""
    plans = []
    for drop in (True, False):
        plan, rest = solve(histogram, capacity, drop)
        plan.update(best_fit(rest, capacity))
        plans.append(plan)
        if plan.total() == -(-sum(k * n for k, n in histogram.items()) // capacity):
            break  # no plan needs fewer
    return sorted(min([*plans, best_fit(histogram, capacity)], key=Counter.total).items(), reverse=True)


def places(plan: list[tuple[tuple, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, lo, hi, each, sequence, offset)``: the ranks from lo to hi of a length go, ``each`` a sequence, to sequences from ``sequence`` on."""
    rows, taken, sequence = [], Counter(), 0
    for config, times in plan:
        offset = 0
        for length, n in config:
            rows.append((length, taken[length], taken[length] + n * times, n, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    Only the histogram (at most ``capacity`` rows) reaches the driver, and the plan sent
    back has a size bounded by the capacity and the rounds, not by the data. A piece's
    rank among those of its length comes from a rank within a hash group plus the sizes
    of the groups before, so a length held by a third of all pieces is spread out.
    Repeated rows get a place each; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_GROUPS)).cast("int")
    pieces = pieces.withColumn("part", part)
    sizes = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "sizes")
    histogram = {int(r.length): int(r.n) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(places(configurations(histogram, capacity)), "length long, lo long, hi long, each long, first long, at long")
    before = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own"))
    k = F.col("rank") - F.col("lo")
    placed = ranked.alias("r").join(F.broadcast(plan).alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("r.*", (F.col("first") + F.expr("(rank - lo) div each")).alias("sequence_id"), (F.col("at") + k % F.col("each") * F.col("r.length")).alias("offset")).drop("part", "own", "base", "rank")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece with its sequence and offset."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity)
