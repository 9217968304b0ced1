"""BPE encoding and decoding with a lexicon automaton.

The most frequent white-space separated words of the corpus, with their ids, are compiled
into a minimal acyclic automaton that shares prefixes and suffixes. Each arc counts the
words passed over, so a word's path sums to its number in the lexicon, and from there to
its ids. The compiled file goes to every executor once and is memory-mapped there. Words
that it does not hold are split and merged exactly by rank.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickgrid.llm.common import text_or_empty, written

#: How many words the lexicon holds at most.
LEXICON_WORDS = 50_000
#: Words that a task remembers before it starts anew.
MEMORY = 400_000

#: Python's str.split() also splits at these, which are no white space to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters whose case, composition or class depends on more than simple tables.
_RARE = re.compile("[^\x00-\u024f]")
_NONE = 1 << 60
_SPACES = regex.compile(r"\p{White_Space}+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class WordBPE:
    """A word-level BPE vocabulary read from a tokenizers file: NFC, lower case, word ends marked."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letters = byte_alphabet()
        self.library = Tokenizer.from_file(path)

    def merged(self, letters: str) -> list[int]:
        """The ids of one piece, given in byte letters: the best-ranked neighbours are joined until none can be."""
        if len(letters) > 40:
            return self._merged_long(letters)
        parts = [*letters[:-1], letters[-1] + self.end]
        rank = self.ranks.get
        waiting = [rank(p, _NONE) for p in zip(parts, parts[1:])]
        while waiting and (best := min(waiting)) != _NONE:
            at = waiting.index(best)
            parts[at] += parts.pop(at + 1)
            del waiting[at]
            if at:
                waiting[at - 1] = rank((parts[at - 1], parts[at]), _NONE)
            if at < len(waiting):
                waiting[at] = rank((parts[at], parts[at + 1]), _NONE)
        return [self.vocab[p] for p in parts]

    def _merged_long(self, letters: str) -> list[int]:
        """The same for a long piece: candidate pairs wait in a heap over a linked list, which costs n log n."""
        parts: list[str | None] = [*letters[:-1], letters[-1] + self.end]
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # one of them has been joined meanwhile
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (r := rank((parts[k], parts[right[k]]))) is not None:
                    heappush(heap, (r, k, parts[k], parts[right[k]]))
        return [self.vocab[p] for p in parts if p is not None]

    def split(self, word: str) -> list[str]:
        """The pieces, in byte letters, of a word of normalised text, which holds no white space."""
        if word.isascii() and word.isprintable():
            return [word] if word.isalpha() else self.pieces.findall(word)
        if is_rare(word):  # which characters are letters is up to the library's own tables
            return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]
        return ["".join(map(self.letters.__getitem__, m.encode())) for m in self.pieces.findall(word)]

    def word(self, word: str) -> list[int]:
        return [i for p in self.split(word) for i in self.merged(p)]

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """Special tokens stand apart, (True, token); what lies between is normalised."""
        parts = self.cut.split(text) if any(t in text for t in self.special) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield True, part
            elif part:
                yield False, self.library.normalizer.normalize_str(part) if is_rare(part) else part.lower()


def is_rare(text: str) -> bool:
    """Whether a text has characters whose treatment is up to the library's tables. Most texts are told by one copy, without a search."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _RARE.search(text) is not None
    return False


def words_of(text: str) -> list[str]:
    """The white-space separated words of normalised text."""
    return [w for w in _SPACES.split(text) if w] if any(c in text for c in _SEPARATORS) else text.split()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBPE:
    return WordBPE(path)


# --- the lexicon ----------------------------------------------------------------

_MAGIC = b"LEX1"
_ARC = struct.Struct("<II").unpack_from


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """Words and ids -> a minimal acyclic automaton with word numbers, then the ids of each number.

    Words are added in byte order; a state is frozen once no later word can change it,
    and equal frozen states are made one, which shares the suffixes.
    """
    states: list[tuple[bool, tuple]] = []  # frozen: final, ((byte, state), ...)
    known: dict[tuple, int] = {}
    path: list[list] = [[False, []]]  # unfrozen: final, arcs
    last = b""

    def freeze(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], known[key])

    words = sorted((w.encode(), ids) for w, ids in entries.items())
    for word, _ in words:
        same = len(os.path.commonprefix([last, word]))
        freeze(same)
        for b in word[same:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    root = len(states)
    states.append((path[0][0], tuple(path[0][1])))

    count = []  # words below each state; children are frozen before their parents
    for final, arcs in states:
        count.append(final + sum(count[s] for _, s in arcs))
    table, first = bytearray(), []
    for final, arcs in states:
        first.append(len(table))
        table += struct.pack("<BH", final, len(arcs)) + bytes(b for b, _ in arcs)
        passed = int(final)
        for _, s in arcs:
            table += struct.pack("<II", first[s], passed)
            passed += count[s]
    ids, offsets = bytearray(), [0]
    for _, own in words:
        ids += struct.pack(f"<{len(own)}H", *own)
        offsets.append(len(ids))
    head = _MAGIC + struct.pack("<III", first[root], len(table), len(words))
    return bytes(head + table + struct.pack(f"<{len(offsets)}I", *offsets) + ids)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.data[:4] != _MAGIC:
            raise ValueError("no lexicon file")
        self.root, size, n = struct.unpack_from("<III", self.data, 4)
        self.states = 16
        self.offsets = self.states + size
        self.ids = self.offsets + 4 * (n + 1)

    def get(self, word: str) -> list[int] | None:
        """The ids of a word, or None where the lexicon does not hold it."""
        data, find, at, number = self.data, self.data.find, self.states + self.root, 0
        letters = word.encode()
        for k in range(len(letters)):
            n = data[at + 1] | data[at + 2] << 8
            i = find(letters[k : k + 1], at + 3, at + 3 + n)
            if i < 0:
                return None
            target, passed = _ARC(data, at + 3 + n + 8 * (i - at - 3))
            at = self.states + target
            number += passed
        if not data[at]:
            return None
        a, b = _ARC(data, self.offsets + 4 * number)
        return list(struct.unpack_from(f"<{(b - a) // 2}H", data, self.ids + a))


def frequent_words(docs: DataFrame, tokenizer: str, n: int = LEXICON_WORDS) -> list[str]:
    """The ``n`` most frequent words over all texts, ties by the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(tokenizer)
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for special, part in model.segments(text.as_py()):
                    if not special:
                        total.update(words_of(part))
                if len(total) > MEMORY:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counts = docs.select(text_or_empty().alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    # How many words there are by order of frequency tells from where on the top ones start; only those are sorted and fetched.
    level = F.floor(F.log2("n") * 8)
    held, lowest = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        held, lowest = held + r.words, r.level
        if held >= n:
            break
    return [r.word for r in counts.filter(level >= lowest).orderBy(F.desc("n"), "word").limit(n).collect()]


def share_lexicon(docs: DataFrame, tokenizer: str, n: int = LEXICON_WORDS) -> str:
    """Compile the corpus's lexicon and hand it to the executors; the name to open it by."""
    model = vocabulary(tokenizer)
    data = compile_lexicon({w: model.word(w) for w in frequent_words(docs, tokenizer, n)})
    name = f"lexicon-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with open(path, "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(path)
    return name


class Encoder:
    """Encodes texts word by word. What it has seen lately it knows at once: words met since the memory last filled, and those of the time before."""

    def __init__(self, model: WordBPE, lexicon: Lexicon) -> None:
        self.model, self.lexicon = model, lexicon
        self.seen: dict[str, tuple[int, str, str]] = {}
        self.before: dict[str, tuple[int, str, str]] = {}

    def _new(self, word: str) -> tuple[int, str, str]:
        found = self.before.get(word)
        if found is None:
            ids = self.lexicon.get(word)
            if ids is None:
                pieces = self.model.split(word)
                if len(pieces) == 1:
                    ids = self.model.merged(pieces[0])
            if ids is not None:
                found = (len(ids), " ".join(map(str, ids)), " ".join(map(self.model.token.__getitem__, ids)))
            else:  # pieces are remembered too: they are met with other signs around them
                parts = [self._piece(p) for p in pieces]
                found = (sum(x[0] for x in parts), " ".join(x[1] for x in parts), " ".join(x[2] for x in parts))
        if len(self.seen) >= MEMORY:
            self.before, self.seen = self.seen, {}
        self.seen[word] = found
        return found

    def _piece(self, piece: str) -> tuple[int, str, str]:
        if piece.isascii() and piece.isalpha():
            return self.seen.get(piece) or self._new(piece)
        ids = self.model.merged(piece)
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.model.token.__getitem__, ids))

    def encode(self, text: str) -> list[tuple[int, str, str]]:
        """Per word: how many ids, the ids in decimal, and their tokens; words without ids are left out."""
        known, out = self.seen.get, []
        for special, part in self.model.segments(text):
            if special:
                out.append((1, str(self.model.special[part]), part))
            else:
                out += [x for w in words_of(part) if (x := known(w) or self._new(w))[0]]
        return out


@lru_cache(maxsize=1)
def _encoder(tokenizer: str, lexicon: str) -> Encoder:
    """The encoder of this Python worker; later tasks find what it remembers."""
    return Encoder(vocabulary(tokenizer), Lexicon(lexicon))


def decode(ids: list[int], model: WordBPE) -> str:
    """The text of ids as the vocabulary's own decoding gives it: tokens joined by one space."""
    return " ".join(model.token[i] for i in ids if i in model.token)


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every row of ``docs(doc_id, text)``; null counts as empty."""
    name = share_lexicon(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, SparkFiles.get(name))
        for batch in batches:
            ids = [[int(i) for x in encoder.encode(t.as_py() or "") for i in x[1].split()] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs(doc_id, text)``.

    Null counts as empty: no tokens. Repeated rows are encoded alike, extra columns
    ignored, and an empty table gives an empty one. Only the lexicon's words reach the driver.
    """
    name = share_lexicon(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, SparkFiles.get(name))
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                found = encoder.encode(text.as_py() or "")
                n.append(sum(x[0] for x in found))
                ids.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([x[2] for x in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
