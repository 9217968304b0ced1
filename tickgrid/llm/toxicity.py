"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear SVM.

Two strings are alike as far as they share subsequences of three letters, each weighted
down with the room it spans, so an insult with inserted characters or gaps still shares
most of its subsequences with the plain word. A bounded sample of labelled documents is
learned from, sentence by sentence: word statistics give a first model, which points out
the most suspicious word of each sentence; the SVM is then trained on the sentences,
each through that word (a sentence of a toxic document is toxic if its worst word is the
document's worst). Kernel values against landmark words, whitened, are the features. They
are linear in the subsequence vector of a string, so the model folds into one weight per
subsequence, of a fixed size.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.common import plainly_named, text_or_empty, written
from tickgrid.llm.near import MARK, marked, near_copies

#: Subsequences span at most SPAN places; DECAY is what each place costs; longer strings are read in overlapping parts.
SPAN, DECAY, PART = 7, 0.7, 16
LETTERS = 27
#: The bound on labelled documents that a model is fitted on, and on strings that reach the driver.
SAMPLE_DOCS, CANDIDATES, BENIGN = 10_000, 2_000, 6_000
LANDMARKS = 96
#: A witness starts words of toxic documents this much likelier (log odds); at most this share of those found is expected by chance.
MIN_ODDS, FALSE_SHARE = 1.7, 0.01
#: The bounds on disturbed forms of insults and on words of sentences that the SVM is trained on; the weight of sentences that are not their document's worst.
FORMS, SENTENCE_WORDS, OTHERS = 20_000, 20_000, 0.05
#: Strings whose vectors, and rows whose features, the driver holds at once.
VECTORS, ROWS = 256, 4096
#: Lengths of word beginnings that are looked at; a stem may be followed by any ending.
STEMS = range(4, 13)
THRESHOLD = 0.3
#: The margin from which on a word is a hit.
HIT = 0.3
#: Words that a task remembers before it starts anew.
MEMORY = 500_000

#: Digits and signs often written for letters (fixed values).
LOOKS_LIKE = str.maketrans("013457@$", "oieastas")
_SENTENCE = r"[.!?\n]+"
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def _folded(word: str) -> str:
    """Lower case without accents, look-alike signs as letters, no signs at the ends."""
    word = word.lower()
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    if not word.isalnum():
        word = _EDGES.sub("", word)
    return word if word.isalpha() or not any(map(str.isalpha, word)) else word.translate(LOOKS_LIKE)


def units(text: str) -> dict[str, int]:
    """The strings of a text that are scored, with their counts: its words, and runs of single characters joined up."""
    found = Counter(text.split())
    found.update(re.sub(r"\s+", "", m) for m in _SPACED.findall(text))
    return found


def wholes(unit: str) -> list[str]:
    """A unit, in overlapping parts where it is long."""
    return [unit[i : i + PART] for i in range(0, max(1, len(unit) - PART // 2), PART // 2)] if len(unit) > PART else [unit]


def parts(unit: str) -> list[str]:
    """A unit's parts and their beginnings, which may be stems."""
    return [p[:n] for p in wholes(unit) for n in (*STEMS, PART) if n < len(p)] + wholes(unit)


@lru_cache(maxsize=None)
def _picks(width: int) -> tuple[np.ndarray, ...]:
    """Places of all subsequences in a string of ``width``, by their last place; their weights."""
    found = sorted(((i, j, k) for i, j, k in combinations(range(width), 3) if k - i < SPAN), key=lambda p: (p[2], p))
    i, j, k = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return i, j, k, (DECAY ** (k - i - 2.0)).astype(np.float32)


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights of strings of one length, in the order of _picks; 0 stands for none."""
    width = len(strings[0])
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4").reshape(-1, width).astype(np.int32) - 96
    codes[(codes < 1) | (codes > 26)] = 0
    i, j, k, weight = _picks(width)
    a, b, c = codes[:, i], codes[:, j], codes[:, k]
    number = np.where((a > 0) & (b > 0) & (c > 0), (a * LETTERS + b) * LETTERS + c, 0)
    return number, np.where(number > 0, weight, np.float32(0))


def by_length(strings: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Blocks of strings of one length, with their places."""
    lengths = np.array([len(s) for s in strings])
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        for at in range(0, len(own), 4096):
            block = own[at : at + 4096]
            yield block, [strings[i] for i in block]


def vectors(strings: list[str]) -> np.ndarray:
    """Subsequence vectors, dense, divided by the root of the summed squares of all occurrences; for landmarks and training words."""
    out = np.zeros((len(strings), LETTERS**3), np.float32)
    for places, block in by_length(strings):
        number, weight = subsequences(block)
        np.add.at(out, (places[:, None], number), weight / np.sqrt(np.maximum((weight**2).sum(1, keepdims=True), 1e-9)))
    out[:, 0] = 0
    return out


def margins(strings: list[str], beta: np.ndarray, bias: float) -> np.ndarray:
    """The SVM's largest margin over each string and its beginnings.

    Subsequences come by their last place, so running sums give all beginnings at once.
    """
    out = np.full(len(strings), bias, np.float64)
    for places, block in by_length(strings):
        width = len(block[0])
        if width < 3:
            continue
        number, weight = subsequences(block)
        value = np.cumsum(beta[number] * weight, axis=1)
        size = np.cumsum(weight * weight, axis=1)
        last = _picks(width)[2]
        ends = np.searchsorted(last, [n for n in (*STEMS, width) if n <= width]) - 1
        out[places] = (value[:, ends] / np.sqrt(np.maximum(size[:, ends], 1e-9))).max(1) + bias
    return out


def _disturbed(word: str) -> list[str]:
    """Forms of a word with gaps, inserted and doubled characters."""
    middle = range(1, len(word))
    return [word, "".join(c + "." for c in word)[:-1], *(word[:i] + x + word[i:] for i in middle for x in ("x", "-", word[i]))]


def nystroem(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the landmarks and what whitens kernel values against them."""
    land = vectors(landmarks)
    value, basis = np.linalg.eigh(land @ land.T)
    keep = value > 1e-6
    return land, basis[:, keep] / np.sqrt(value[keep])


def fit_words(positive: dict[str, float], negative: dict[str, float], landmarks: list[str]) -> tuple[np.ndarray, float]:
    """A squared-hinge SVM on weighted strings, both classes of equal weight in sum; returned folded, as weights and a bias."""
    words = [*sorted(positive), *sorted(negative)]
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    cost = np.array([positive[w] for w in sorted(positive)] + [negative[w] for w in sorted(negative)])
    land, white = nystroem(landmarks)
    one = np.ones((len(words), white.shape[1] + 1), np.float32)  # the features and a constant
    for i in range(0, len(words), VECTORS):
        one[i : i + VECTORS, :-1] = (vectors(words[i : i + VECTORS]) @ land.T) @ white
    for sign in (1, -1):
        cost[y == sign] /= 2 * max(1e-9, cost[y == sign].sum())
    w = np.zeros(one.shape[1])
    for _ in range(25):  # Newton steps on the squared hinge, summed up over blocks of rows
        bend, slope = 1e-3 * np.eye(len(w)), np.zeros(len(w))
        for i in range(0, len(words), ROWS):
            rows, sign = one[i : i + ROWS].astype(np.float64), y[i : i + ROWS]
            active = sign * (rows @ w) < 1
            inside = rows[active] * cost[i : i + ROWS][active, None]
            bend += inside.T @ rows[active]
            slope += inside.T @ sign[active]
        w = np.linalg.solve(bend, slope)
    return (land.T @ (white @ w[:-1])).astype(np.float64), float(w[-1])


def _forms(insults: dict[str, float], bound: int = FORMS) -> dict[str, float]:
    """Insults with their disturbed forms, as many as the bound allows; the forms of one weigh as much as itself."""
    out: dict[str, float] = {}
    found = {w: sorted({p for d in _disturbed(w) for p in parts(d)}) for w in sorted(insults)}
    step = -(-sum(map(len, found.values())) // bound) or 1
    for w, forms in found.items():
        for p in wholes(w):
            out[p] = out.get(p, 0) + insults[w]
        some = forms[::step]
        for p in some:
            out[p] = out.get(p, 0) + insults[w] / len(some)
    return out


def fit_witnesses(witnesses: list[str], benign: list[str]) -> tuple[np.ndarray, float]:
    """The first model, from witness words against benign ones."""
    positive = dict.fromkeys(_forms(dict.fromkeys(witnesses, 1.0)), 1.0)
    negative = dict.fromkeys(set(benign) - set(positive), 1.0)
    plain = sorted(negative)
    return fit_words(positive, negative, witnesses[:: -(-len(witnesses) // LANDMARKS)] + plain[:: max(1, len(plain) // LANDMARKS)][:LANDMARKS])


def fit_sentences(sentences: list[tuple[str, float, float]], benign: list[str]) -> tuple[np.ndarray, float]:
    """The model from sentences, given as (worst word, weight in toxic sentences, weight in benign ones)."""
    bad = {w: n for w, n, _ in sentences if n}
    good = {w: n for w, _, n in sentences if n}
    balance = sum(good.values()) / max(1e-9, sum(bad.values()))
    # Disturbed forms only of what is toxic more often than not.
    insults = {w: n for w, n in bad.items() if n * balance > good.get(w, 0)}
    positive = {w: n for w, n in bad.items() if w not in insults} | _forms(insults)
    # Words that are in no sentence's worst place are benign too.
    rest = set(benign) - set(good) - set(positive) - {""}
    negative = good | dict.fromkeys(rest, sum(good.values()) / max(1, len(rest)))
    heavy = lambda d: sorted(d, key=lambda w: (-d[w], w))
    land = heavy(insults)[:LANDMARKS] + heavy(good)[: LANDMARKS // 2] + sorted(rest)[:: max(1, 2 * len(rest) // LANDMARKS)][: LANDMARKS // 2]
    return fit_words(positive, negative, sorted(set(land)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled documents that may be learned from (crc32 of the id as text, modulo 4, is not 2), about ``sample`` at most.

    Where there are more, a part is chosen by a hash of the id alone. Near copies (whole
    texts, as in the near-dedup stage) with one label count once.
    """
    labelled = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = labelled.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    n = labelled.count()
    if n > sample:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(n)) < sample)
    rows = written(marked(docs.select("doc_id", text_or_empty().alias("text")).join(labelled, "doc_id")), "sample")
    # Near copies would make any of their words look telling: of each group the smallest doc_id is taken.
    groups = near_copies(rows).select("doc_id", "set_id", "component").distinct().join(labelled, "doc_id")
    first = groups.groupBy("component", "toxic").agg(F.min(F.struct("doc_id", "set_id")).alias("first")).select("first.*")
    kept = rows.join(first.withColumnRenamed("set_id", MARK), ["doc_id", MARK], "left_semi")
    return kept.groupBy("doc_id", "toxic", MARK).agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> dict:
    """Train on the labelled sample: folded weights, their bias, and the scale from margins to scores."""
    rows = written(training_rows(docs, labels, sample), "labelled")
    # A witness begins words in the sentences of toxic documents and hardly any in benign ones.
    sentences = F.explode(F.split(F.lower("text"), _SENTENCE)).alias("sentence")
    words = rows.select("doc_id", "toxic", sentences).select("doc_id", "toxic", F.explode(F.split("sentence", r"\s+")).alias("word"))
    word = F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    words = written(words.select("doc_id", "toxic", word.alias("word")).filter("word <> ''").distinct(), "words")
    totals = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    n_bad, n_good = int(totals[0]), int(totals[1])
    empty = {"beta": np.zeros(LETTERS**3), "bias": -1.0, "scale": np.array([1.0, 0.0, 0.0, -2.0])}
    if not n_bad or not n_good:
        return empty
    stem = F.explode(F.filter(F.transform(F.array(*map(F.lit, STEMS)), lambda n: F.substring("word", F.lit(1), n)), lambda x: F.length(x) >= STEMS[0])).alias("stem")
    # Stems of toxic documents, and how often benign ones hold those.
    in_bad = written(words.filter("toxic = 1").select("doc_id", stem).distinct().groupBy("stem").agg(F.count("*").alias("bad")), "stems")
    tried, most = in_bad.agg(F.count("*"), F.max("bad")).first()
    if not tried:  # no word of the toxic documents has as many letters as a stem
        return empty
    # Rarer stems cannot be told from chance even if no benign document holds them.
    often = in_bad.filter(F.col("bad") >= min(most, math.ceil(math.log(FALSE_SHARE) / math.log(n_bad / (n_bad + n_good)))))
    in_good = words.filter("toxic = 0").select("doc_id", stem).join(often, "stem", "left_semi").distinct().groupBy("stem").agg(F.count("*").alias("good"))
    counted = written(often.join(in_good, "stem", "left").na.fill(0, ["good"]), "counted")
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    # Counts are of a bounded sample, so few pairs of counts differ.
    pairs = {(r.bad, r.good): r.n for r in counted.groupBy("bad", "good").agg(F.count("*").alias("n")).collect()}
    telling = docs.sparkSession.createDataFrame(_telling(pairs, tried, n_bad, n_good), "bad long, good long")
    found = counted.join(telling, ["bad", "good"], "left_semi").orderBy(F.desc(F.col("bad") * odds), "stem").limit(CANDIDATES)
    witnesses = _longest({r.stem: r.bad for r in found.collect()})
    benign = words.filter("toxic = 0").groupBy("word").agg(F.count("*").alias("good"))
    common = benign.orderBy(F.desc("good"), "word").limit(BENIGN // 3).collect()
    spread = benign.orderBy(F.xxhash64("word"), "word").limit(BENIGN // 3).collect()
    plain = sorted({p for r in [*common, *spread] for p in parts(_folded(r.word))})
    beta, bias = fit_witnesses(witnesses, plain)
    beta, bias = fit_sentences(_sentence_words(rows, beta, bias), plain)
    seen = scored(rows, {"beta": beta, "bias": bias, "scale": None}).join(rows.select("doc_id", "toxic"), "doc_id").collect()
    return {"beta": beta, "bias": bias, "scale": _scale(np.array([(r.best, r.hits, r.density) for r in seen]), np.array([r.toxic for r in seen], float))}


def _sentence_words(rows: DataFrame, beta: np.ndarray, bias: float) -> list[tuple[str, float, float]]:
    """The worst word of each sentence under a model, with the weights of its toxic and benign sentences.

    A toxic document's worst sentence counts as toxic and its others not at all; a benign
    one's worst sentence counts as benign, its others with the weight OTHERS. At most
    SENTENCE_WORDS words are kept, the heaviest and so the most telling ones.
    """
    shared = rows.sparkSession.sparkContext.broadcast(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.astype(np.float32)
        for batch in batches:
            out: list[tuple] = []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found = [{p for u in units(x) for p in parts(_folded(u)) if p} for x in re.split(_SENTENCE, text.as_py())]
                words = sorted(set().union(*found))
                if not words:
                    continue
                value = dict(zip(words, margins(words, weights, bias).tolist()))
                worst = [max(f, key=lambda w: (value[w], w)) for f in found if f]
                first = max(worst, key=lambda w: (value[w], w))
                out.append((first, float(toxic), float(1 - toxic)))
                out += [(w, 0.0, OTHERS) for w in worst if not toxic]
            columns = zip(*out) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64()))], ["word", "bad", "good"])

    words = rows.select("text", "toxic").mapInArrow(run, "word string, bad double, good double").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return [tuple(r) for r in words.orderBy(F.desc("bad"), F.desc(F.round("good", 6)), "word").limit(SENTENCE_WORDS).collect()]


def _telling(pairs: dict[tuple[int, int], int], tried: int, n_bad: int, n_good: int) -> list[tuple[int, int]]:
    """The counts (toxic, benign) of witnesses, given the number of stems for each pair of counts.

    An exact binomial test, with the false discoveries among all stems ``tried`` bounded
    (Benjamini and Hochberg). Where labels are too few for any stem to pass, those of the
    smallest p-value are taken, so that both classes always give a model.
    """
    rate = n_bad / (n_bad + n_good)
    of = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, max(b + g for b, g in pairs) + 1)))])

    def chance(bad: int, good: int) -> float:
        """The logarithm of the chance of so many toxic documents among those that hold a stem."""
        k = np.arange(bad, bad + good + 1)
        each = of[bad + good] - of[k] - of[bad + good - k] + k * math.log(rate) + (bad + good - k) * math.log(1 - rate)
        return float(each.max() + math.log(np.exp(each - each.max()).sum()))

    ranked = sorted((chance(*p), -p[0], p) for p in pairs)
    bound, seen = -math.inf, 0
    for value, _, p in ranked:
        seen += pairs[p]
        if value <= math.log(FALSE_SHARE * seen / tried):
            bound = value
    odds = lambda p: math.log((p[0] + 0.5) / (n_bad + 1)) - math.log((p[1] + 0.5) / (n_good + 1))
    return [p for value, _, p in ranked if value <= bound and odds(p) >= MIN_ODDS] or [ranked[0][2]]


def _longest(stems: dict[str, int]) -> list[str]:
    """The shortest stems, each made longer as long as nearly all of its documents go on in the same way."""
    chosen = []
    for stem in sorted(stems, key=lambda x: (len(x), x)):
        if any(stem[:n] in stems for n in range(1, len(stem))):
            continue  # a form of a shorter one
        at = stem
        while longer := [x for x in stems if len(x) == len(at) + 1 and x.startswith(at) and stems[x] >= 0.9 * stems[stem]]:
            at = longer[0]
        chosen.append(_folded(at))
    return sorted(set(chosen))


def _scale(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic model from a document's largest margin, number and density of hits to its score."""
    one = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(4)
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        bend = (one * (p * (1 - p))[:, None]).T @ one / len(y) + 1e-4 * np.eye(4)
        w -= np.linalg.solve(bend, one.T @ (p - y) / len(y) + 1e-4 * w)
    return w


def scored(docs: DataFrame, model: dict, id_type: str = "long") -> DataFrame:
    """``doc_id, score`` and what it is made of, for every row and over the whole text.

    These are the largest margin of a string, how many words are hits, and their density.
    """
    beta, bias, scale = docs.sparkSession.sparkContext.broadcast(model["beta"]), model["bias"], model["scale"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        weights = beta.value.astype(np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [units(t.as_py() or "") for t in some.column(1)]
                new = list(set().union(*texts).difference(known))
                if len(known) + len(new) > MEMORY:
                    known.clear()
                    new = list(set().union(*texts))
                folded = [_folded(u) for u in new]
                known.update(zip(new, margins([f[:PART] for f in folded], weights, bias).tolist()))
                for u, f in zip(new, folded):
                    if len(f) > PART:
                        known[u] = max(margins(wholes(f), weights, bias).tolist())
                best = np.array([max((known[u] for u in us), default=bias) for us in texts])
                high = {u for us in texts for u in us if known[u] >= HIT}
                hits = np.array([sum(us[u] for u in high.intersection(us)) for us in texts], float)
                size = np.array([max(1, us.total()) for us in texts], float)
                x = np.stack([best, np.log1p(hits), np.log1p(100 * hits / size)], axis=1)
                score = x[:, 0] if scale is None else 1 / (1 + np.exp(-np.clip(x @ scale[:3] + scale[3], -30, 30)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(score), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2])], ["doc_id", "score", "best", "hits", "density"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double, best double, hits double, density double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Scores come from the text alone; null and empty texts get the score of no words.
    Without labels of both classes every score is low. ``held_out`` marks documents
    whose labels are never learned from (false for a null id).
    """
    out = scored(docs, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic. Rows that share a doc_id go together; null ids stay. Columns are those of ``docs``, whatever those are called."""
    own = plainly_named(docs)
    bad = classify(own, labels).filter("predicted = 1").select("doc_id").distinct()
    return own.join(bad, "doc_id", "left_anti").select(*own.columns).toDF(*docs.columns)
