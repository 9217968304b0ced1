"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose candidate spans. Several labelers (pattern shape, gazetteer, context,
checksum) vote on each one: for, against or not at all. Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is, and a span
classifier over the span's own features (length, characters, what stands before it) and
the votes is trained on the resulting posteriors. The base kinds, which are fixed by
their patterns and checks, always stay; further candidates stay where the classifier
accepts them. All steps over a text cost time in proportion to it, however many spans it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.common import text_or_empty, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "localphone", "name")
#: Characters before a span that the context labelers see.
CONTEXT = 32
#: A candidate of a further kind is accepted from this probability on.
ACCEPT = 0.5

#: The gazetteers: common first names, forms of address, words that follow names but are none, and top-level domains (fixed values).
FIRST_NAMES = (
    "Ahmed Alice Amanda Amy Andrea Andrew Angela Anna Anne Antonio Barbara Beatriz Benjamin Betty Brian Carla Carlos Carmen Carol Catherine Charles Charlotte Christian "
    "Christine Christopher Claire Claudia Cynthia Daniel David Deborah Dennis Diana Diego Donald Donna Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Fatima Felix Fernando "
    "Francesca Francisco Frank Gabriel Gary George Giulia Grace Hannah Hans Heather Helen Helga Henry Ingrid Isabel Jack Jacob James Jan Jane Janet Jason Javier Jean Jeffrey "
    "Jennifer Jessica Joan Johanna John Jonathan Jorge Jose Joseph Joshua Juan Julia Julie Karen Karl Katherine Kathleen Kenneth Kevin Klaus Larry Laura Lauren Linda Lisa Louis "
    "Lucas Lucia Luis Manuel Marco Margaret Maria Marie Mark Markus Martha Martin Mary Matthew Megan Melissa Michael Michelle Miguel Mohammed Monica Nancy Nicholas Nicole Nicolas "
    "Olivia Pablo Pamela Patricia Patrick Paul Paula Pedro Peter Philip Philippe Pierre Rachel Raymond Rebecca Richard Robert Roberto Ronald Rosa Ruth Ryan Samuel Sandra Sara Sarah "
    "Scott Sharon Simon Sofia Sophie Stefan Stephanie Stephen Steven Susan Sven Teresa Thomas Timothy Tyler Ursula Victoria Virginia Walter William Wolfgang Yusuf"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame".split()
NO_SURNAMES = "The And But For Was Has Had Is In On At By Of To It He She We They Street Avenue Road City County University College Company River Lake".split()
DOMAINS = "com org net edu gov de fr es it uk eu io nl pl br ru in cn jp au ca ch".split()

# The patterns find exactly the leftmost non-overlapping matches of the plain forms, but
# start only where a run starts and never give characters back, so that long runs of
# letters or digits cost linear time and constant stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<=(?:password|passwd|token|secret|api_key)[\x20]{0,3}[=:][\x20]{0,3}[\x22']?)[A-Za-z0-9_-]{12,}+",
    "localphone": r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}(?![0-9-])",
    "name": rf"(?<![\p{{L}}'])(?:(?:{'|'.join(FIRST_NAMES)})[\x20]\p{{Lu}}\p{{Ll}}{{1,30}}+|(?:{'|'.join(TITLES)})\.?[\x20](?:\p{{Lu}}\p{{Ll}}{{1,30}}+[\x20])?\p{{Lu}}\p{{Ll}}{{1,30}}+)(?![\p{{L}}'])",
}

#: Cheap tests that a text must pass before a pattern is tried on it.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.rlike(r"(?:password|passwd|token|secret|api_key)[\x20]{0,3}[=:]"),
    "localphone": lambda t: t.rlike(r"[0-9]{3}-[0-9]{4}"),
    "name": lambda t: t.rlike(r"[\p{Ll}.][\x20]\p{Lu}"),
}

SPANS = "array<struct<kind: string, start: long, end: long, votes: array<int>, features: array<int>>>"
#: Elements that a running sum appends one by one, and characters that a text is cut into blocks of.
CHUNK, BLOCK = 64, 1024


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _part(values: Column, first: Column, last: Column) -> Column:
    """The elements from ``first`` to ``last``, by index: ``slice`` would copy the whole array each time."""
    return F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), lambda j: values[j])).otherwise(F.slice(values, 1, 0))


def _running(values: Column, step: Callable[[Column, Column], Column], zero: Column, levels: int = 2) -> Column:
    """For each element what ``step`` makes of ``zero`` and all elements before it.

    ``step`` must be associative. Elements go in chunks, and chunks in chunks, because appending
    one by one to an array copies it each time.
    """

    def plain(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(part, start, lambda s, v: F.struct(step(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    if not levels:
        return plain(values, zero)

    def chunks(values: Column) -> Column:
        last = F.greatest(F.ceil(F.size(values) / CHUNK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: _part(values, i * CHUNK, F.least((i + 1) * CHUNK, F.size(values)) - 1))

    def joined(parts: Column) -> Column:
        first = _running(F.transform(parts, lambda p: F.aggregate(p, zero, step)), step, zero, levels - 1)
        return _let(first, lambda at: F.flatten(F.transform(parts, lambda p, i: plain(p, at[i]))))

    return _let(_let(values, chunks), joined)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _min(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check: from the right, every second digit doubled."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """What a match must satisfy besides its pattern."""
    digits = _digits(value)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _vote(for_it: Column, against: Column | None = None) -> Column:
    vote = F.when(for_it, 1)
    return (vote.when(against, -1) if against is not None else vote).otherwise(0)


def _votes(kind: str, value: Column, before: Column) -> Column:
    """The labelers' votes: shape, gazetteer, context, checksum."""
    digits = _digits(value)
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 4
    words = {
        "email": "mail|contact|write|reach|address",
        "ip": "ip|host|server|address|from|login",
        "card": "card|visa|pay|credit|account",
        "phone": "call|phone|tel|fax|mobile|contact",
        "localphone": "call|phone|tel|fax|mobile|contact",
        "secret": "password|passwd|token|secret|api_key",
        "name": "name|mr|ms|mrs|dr|contact|by|dear|from|signed",
    }[kind]
    gazetteer = {
        "email": value.rlike(rf"\.(?:{'|'.join(DOMAINS)})$"),
        "ip": value.rlike(r"^(?:10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\."),
        "card": digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"),
        "phone": value.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"),
        "localphone": ~digits.rlike(r"^(?:[01]|[0-9]{3}[01])"),
        "secret": ~F.lower(value).rlike(r"^(?:changeme|example|placeholder|xxx)"),
        "name": F.split(value, " ")[0].isin(*FIRST_NAMES),
    }[kind]
    checks = {
        "email": _vote(~value.contains(".."), value.contains("..")),
        "ip": _vote(~value.rlike(r"(?:^|\.)0[0-9]"), value.rlike(r"(?:^|\.)0[0-9]")),
        "card": F.lit(1),
        "phone": _vote(F.length(digits).between(11, 13)),
        "localphone": _vote(varied, ~varied),
        "secret": _vote(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), ~value.rlike("[0-9]")),
        "name": _vote(F.length(F.element_at(F.split(value, " "), -1)) >= 3, F.element_at(F.split(value, " "), -1).isin(*NO_SURNAMES)),
    }[kind]
    near = F.lower(before)
    shape = _vote(varied, ~varied)
    context = _vote(near.rlike(rf"(?<!\p{{L}})(?:{words})s?(?!\p{{L}})"), near.rlike(r"(?:version|release|section|figure|page)[\x20:v]*$"))
    return F.array(shape, _vote(gazetteer, ~gazetteer if kind in ("card", "secret", "localphone") else None), context, checks)


#: How many features a span has; each is 0 or 1, so at most 81 * 2**FEATURES patterns of votes and features occur for a kind.
FEATURES = 7


def _features(value: Column, before: Column) -> Column:
    """What the classifier sees of a span besides the votes."""
    tests = [
        F.length(value) >= 12,
        F.length(value) >= 20,
        value.rlike("[0-9]"),
        value.rlike(r"\p{Lu}"),
        value.rlike(r"[^\p{L}0-9]"),
        before.rlike(r"[:=][\x20\x22']*$"),
        before.rlike(r"(?:^|[.!?\n][\x20]*)$"),
    ]
    return F.array(*[F.coalesce(t.cast("int"), F.lit(0)) for t in tests])


def _found(kind: str, text: Column) -> Column:
    """Spans of one kind, from the pieces between the matches and the matches themselves."""
    zero = F.lit(0).cast("long")

    def spans(pair: Column) -> Column:
        gaps, hits = pair["gaps"], pair["hits"]
        # What each match and the piece before it add to the place.
        steps = F.transform(hits, lambda h, i: (F.length(gaps[i]) + F.length(h)).cast("long"))

        def span(at: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                start = at[i] + F.length(gaps[i])
                before = F.right(F.concat(F.when(i > 0, F.right(hits[i - 1], F.lit(CONTEXT))).otherwise(""), F.right(gaps[i], F.lit(CONTEXT))), F.lit(CONTEXT))
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"), before.alias("before"))

            return F.transform(hits, one)

        return _let(_running(steps, _sum, zero), span)

    pair = F.struct(F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("hits"))
    holding = F.filter(_let(pair, spans), lambda s: _holds(kind, s["hit"]))
    voted = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _votes(kind, s["hit"], s["before"]).alias("votes"), _features(s["hit"], s["before"]).alias("features"))
    return F.when(GATES[kind](text), F.transform(holding, voted)).otherwise(F.array().cast(SPANS))


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def candidates(docs: DataFrame, column: str = "text", found: str = "found") -> DataFrame:
    """Add ``found``: every candidate span of every kind with its votes and features. Null counts as empty."""
    text = text_or_empty(column)
    return docs.withColumn(found, F.concat(*[_found(kind, text) for kind in KINDS]))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict:
    """Expectation-maximisation for one kind over ``(votes, count)``: posteriors, accuracies and the prior."""
    n_labelers = len(patterns[0][0])
    right, prior, posterior = [0.8] * n_labelers, 0.7, {}
    for _ in range(rounds):
        for votes, _n in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for a, v in zip(right, votes):
                yes += math.log(a if v > 0 else 1 - a) if v else 0.0
                no += math.log(1 - a if v > 0 else a) if v else 0.0
            posterior[votes] = 1 / (1 + math.exp(min(700.0, no - yes)))
        total = sum(n for _, n in patterns)
        prior = min(0.99, max(0.01, sum(posterior[v] * n for v, n in patterns) / total))
        for j in range(n_labelers):
            cast = sum(n for v, n in patterns if v[j])
            agreed = sum(n * (posterior[v] if v[j] > 0 else 1 - posterior[v]) for v, n in patterns if v[j])
            right[j] = min(0.99, max(0.55, (agreed + 8) / (cast + 10)))  # a labeler is taken to be better than chance
    return {"posterior": posterior, "accuracy": right, "prior": prior}


def train(rows: list[tuple[tuple[int, ...], float, int]], steps: int = 200) -> list[float]:
    """Logistic regression of posteriors on votes and features, from ``(x, posterior, count)``: the bias, then a weight for each."""
    total = sum(n for _, _, n in rows)
    weights = [0.0] * (1 + len(rows[0][0]))
    for _ in range(steps):
        slope = [0.001 * w for w in weights]
        for x, aim, n in rows:
            miss = (1 / (1 + math.exp(-weights[0] - sum(w * v for w, v in zip(weights[1:], x)))) - aim) * n / total
            slope[0] += miss
            for i, v in enumerate(x, 1):
                if v:
                    slope[i] += miss * v
        weights = [w - 2 * s for w, s in zip(weights, slope)]
    return weights


def models(spans: DataFrame) -> dict[str, list[float]]:
    """A span classifier per further kind, from a table with the array ``found``.

    Only counts of patterns (at most 81 * 2**FEATURES a kind, far fewer in practice) reach the driver.
    """
    rows = spans.select(F.explode("found").alias("s")).filter(~F.col("s.kind").isin(*BASE_KINDS)).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n")).collect()
    by_kind: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.kind, r.votes, r.features)):
        by_kind.setdefault(r.kind, []).append((tuple(r.votes), tuple(r.features), r.n))
    out = {}
    for kind, own in by_kind.items():
        votes: dict[tuple, int] = {}
        for v, _, n in own:
            votes[v] = votes.get(v, 0) + n
        posterior = estimate(sorted(votes.items()))["posterior"]
        out[kind] = train([(v + f, posterior[v], n) for v, f, n in own])
    return out


def _ordered(spans: Column) -> Column:
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))


def _accepted(found: Column, weights: dict[str, list[float]]) -> Column:
    """All spans that stay, in order of start, then kind as listed. Further ones must not overlap a base one."""

    def probability(s: Column) -> Column:
        x = F.concat(s["votes"], s["features"])
        score = F.lit(-20.0)
        for kind, w in weights.items():
            score = F.when(s["kind"] == kind, reduce(lambda a, j: a + x[j] * w[j + 1], range(len(w) - 1), F.lit(w[0]))).otherwise(score)
        return 1 / (1 + F.exp(-score))

    base = lambda s: s["rank"] < len(BASE_KINDS)
    last = F.lit((1 << 62)).cast("long")

    def apart(spans: Column) -> Column:
        # The furthest end of base spans before each span, and the nearest begin of one after it.
        ends = _running(F.transform(spans, lambda s: F.when(base(s), s["end"]).otherwise(F.lit(0).cast("long"))), _max, F.lit(0).cast("long"))
        starts = F.reverse(_running(F.reverse(F.transform(spans, lambda s: F.when(base(s), s["start"]).otherwise(last))), _min, last))
        return _let(
            F.struct(ends.alias("ends"), starts.alias("starts")),
            lambda near: F.filter(spans, lambda s, i: base(s) | ((near["ends"][i] <= s["start"]) & (near["starts"][i] >= s["end"]))),
        )

    kept = F.filter(found, lambda s: s["kind"].isin(*BASE_KINDS) | (probability(s) >= ACCEPT))
    # Where there is nothing to set apart the running sums are not needed.
    return _let(_ordered(kept), lambda spans: F.when(F.exists(spans, lambda s: ~base(s)), apart(spans)).otherwise(spans))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def annotate(docs: DataFrame, name: str = "pii") -> DataFrame:
    """Add ``name``, the spans that stay as ``array<struct<start, rank, end, kind>>``, to every row of ``docs``.

    Candidates are found once and written; the classifier is trained on all of them. An
    empty table, null or empty texts give empty arrays; repeated rows are annotated alike.
    A column of that name is replaced; all others stay, whatever they are called.
    """
    found = _fresh(docs, "found")
    tagged = written(candidates(docs, found=found), "pii")
    return tagged.withColumn(name, _accepted(F.col(found), models(tagged.select(F.col(found).alias("found"))))).drop(found)


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of spans of each base kind, ``base_sha256`` and ``spans`` for every row."""
    found = written(candidates(docs.select("doc_id", "text")).select("doc_id", "found"), "pii")  # texts are not written
    tagged = found.select("doc_id", _accepted(F.col("found"), models(found)).alias("pii"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    of_kind = lambda k: F.filter("pii", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return tagged.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span that stays replaced by its kind in brackets; all else is unchanged.

    Overlapping spans are replaced together, by the kind that starts first. Columns may
    have any names.
    """
    name = _fresh(docs, "pii")
    tagged, text = annotate(docs, name), F.col("text")
    far = F.lit(1 << 62).cast("long")

    def replaced(spans: Column) -> Column:
        def with_blocks(x: Column) -> Column:
            blocks, ends = x["blocks"], x["ends"]

            def cut(a: Column, b: Column) -> Column:
                """The characters from a to b, from the blocks that hold them."""
                first = F.floor(a / BLOCK).cast("int")
                held = _part(blocks, first, F.least(F.floor(b / BLOCK), F.size(blocks).cast("long") - 1).cast("int"))
                return F.substring(F.array_join(held, ""), (a - first * BLOCK).cast("int") + 1, F.least(b - a, F.lit((1 << 31) - 1)).cast("int"))

            fresh = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), ends[i].alias("since"))), lambda p: p["start"] >= p["since"])
            pieces = F.transform(fresh, lambda p: F.concat(cut(p["since"], p["start"]), F.lit("["), p["kind"], F.lit("]")))
            rest = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: F.greatest(a, s["end"]))
            return F.concat(F.array_join(pieces, ""), cut(rest, far))

        ends = _running(F.transform(spans, lambda s: s["end"]), _max, F.lit(0).cast("long"))
        return _let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), ends.alias("ends")), with_blocks)

    out = F.when(F.size(name) > 0, replaced(F.col(name))).otherwise(text)
    return tagged.withColumn("text", out).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
