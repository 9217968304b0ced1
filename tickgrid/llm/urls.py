"""URL filter: host and path rules first, then a weighted vocabulary searched by an Aho-Corasick automaton.

The rules are compiled into one column expression. The vocabulary's automaton is built
once in each Python worker; it walks a URL once whatever the number of terms, and each hit
is then tested for its boundaries. A URL is judged by itself: nothing is shuffled, so one
host may hold any share of the rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

#: Points that the distinct soft terms of a URL need, together, to have it rejected; there must be two of them at least.
LIMIT = 100

#: Terms that reject by themselves. A star opens an end: letters and digits may go on there.
STRICT = (
    "adult-x*", "adultdating", "adultx*", "*bitcoindoubler*", "camgirl*", "*casino*", "cialis", "crackz", "escorts", "fakeid", "gambling*", "hentai*", "jackpot*",
    "keygen*", "*malware*", "milf*", "nude*", "onlinepharmacy", "payday*", "*phishing*", "*poker*", "porn*", "roulette*", "sexcam*", "slotmachine*",
    "sportsbook*", "torrentz", "viagra", "warez", "xanax", "x-rated", "xxx", "xxxvideo*",
)

#: Terms that only count together, with their points.
SOFT = {
    "ad": 50, "ads": 50, "adult*": 50, "affiliate": 50, "banner*": 50, "bet": 50, "bets": 50, "betting": 50, "bonus": 50, "bookmaker*": 50, "cheap*": 50,
    "click": 34, "clickid": 50, "coupon*": 34, "crack": 50, "cracked": 50, "credit": 34, "dating": 50, "deal": 34, "deals": 34, "diet": 34, "discount*": 34,
    "download*": 34, "earn": 34, "escort": 50, "fast": 34, "free": 50, "gamble": 50, "girls": 34, "hack*": 50, "hot": 34, "instant": 34, "loan*": 50,
    "lottery": 50, "lucky": 34, "meds": 50, "mirror": 34, "money": 34, "offer*": 34, "pharma*": 50, "pill": 50, "pills": 50, "popup*": 50, "prize*": 50,
    "promo": 34, "replica*": 50, "rx": 50, "serial": 34, "sex*": 50, "slots": 50, "spin": 34, "sweepstake*": 50, "torrent*": 50, "track": 50, "tracker*": 50,
    "tracking": 50, "watch": 34, "weightloss": 50, "win": 50, "winner*": 50,
}

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def lower_ascii(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, in lower case, and from there up to ``?`` or ``#``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def _longest(rules: tuple[Rule, ...], host: Column, path: Column, value: str) -> Column:
    """``value`` of the longest rule that fits (of equally long ones the first), else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.lit(getattr(r, value))).otherwise(found)
    return found


#: A percent escape of an ASCII character.
_ESCAPE = re.compile("%([0-7][0-9A-Fa-f])")


def searched(url: str) -> str:
    """The part of a URL that is searched: after the first ``://`` (or all of it) up to ``#``, ASCII escapes undone, A-Z in lower case."""
    text = url.partition("://")[2] if "://" in url else url
    text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text.partition("#")[0])
    return text.translate(_TO_LOWER)


_TO_LOWER = str.maketrans(_UPPER, _LOWER)


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    """The terms, each with its length, whether its ends are bounded, and its points (none for a strict term)."""
    found = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for term, points in [*((t, None) for t in strict), *soft]:
        entries.setdefault(term.strip("*"), []).append((term, not term.startswith("*"), not term.endswith("*"), points))
    for text, own in entries.items():
        found.add_word(text, (len(text), own))
    found.make_automaton()
    return found


def hits(text: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[str, int | None]]:
    """Every place of a term in ``text`` as term and points, where no ASCII letter or digit stands at a bounded end."""
    inside = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
    for end, (n, own) in automaton.iter(text):
        before, after = inside(end - n), inside(end + 1)
        for term, left, right, points in own:
            if not (left and before or right and after):
                yield term, points


def _counts(url: Column, strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]) -> Column:
    @F.pandas_udf("strict_hits long, soft_hits long, soft_terms long, points long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(strict, soft)
        for urls in batches:
            rows = []
            for u in urls:
                n_strict, n_soft, distinct = 0, 0, {}
                for term, points in hits(searched(u), automaton):
                    if points is None:
                        n_strict += 1
                    else:
                        n_soft += 1
                        distinct[term] = points
                rows.append((n_strict, n_soft, len(distinct), sum(distinct.values())))
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_hits", "soft_terms", "points"], dtype="int64")

    return count(url)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the counts behind it, for every row of ``pages(page_id, url)``.

    The longest rule that fits gives the verdict. Where none fits, the URL is blocked for
    one strict term, or for two or more distinct soft terms of ``limit`` points together; a
    soft term counts its points once, however often it occurs. Terms are searched in host, path
    and query. A null or empty URL is allowed; one without ``://`` has neither host nor path
    but is searched whole. Repeated rows and null ids get a row each; other columns are ignored.
    """
    terms = tuple((SOFT if soft is None else soft).items())
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    rows = rows.select("page_id", *[c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"))], _counts(F.col("url"), strict, terms).alias("c"))
    host, path = F.col("host"), F.col("path")
    rejected = (F.col("c.strict_hits") > 0) | (F.col("c.soft_terms") >= 2) & (F.col("c.points") >= limit)
    own = F.when(rejected, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", _longest(rules, host, path, "name").alias("rule"), F.coalesce(_longest(rules, host, path, "verdict"), own).alias("verdict"), "c.*"
    )


def oracle_sql() -> str:
    """The same rows in SQL: a pattern for each term over URLs whose boundary characters are doubled, so that two places never share one."""

    def pattern(term: str) -> str:
        return ("" if term.startswith("*") else "(^|[^a-z0-9])") + re.sub("([^a-z0-9])", r"\1\1", term.strip("*")) + ("" if term.endswith("*") else "([^a-z0-9]|$)")

    values = ", ".join([*(f"('{t}', '{pattern(t)}', NULL)" for t in STRICT), *(f"('{t}', '{pattern(t)}', {p})" for t, p in SOFT.items())])
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(RULES, key=lambda r: -len(r.name))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, value)}'" for r in ordered) + " END"
    return rf"""
        WITH term(term, pattern, points) AS (VALUES {values}),
        u AS (SELECT row_number() OVER () AS i, page_id, coalesce(url, '') AS url FROM pages),
        r AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
        h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM r),
        p AS (SELECT *, translate(raw_host, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path,
                     string_split(split_part(CASE WHEN contains(url, '://') THEN rest ELSE url END, '#', 1), '%') AS cut FROM h),
        d AS (SELECT *, list_aggregate(list_prepend(cut[1], list_transform(cut[2:], lambda x: CASE WHEN regexp_matches(x, '^[0-7][0-9A-Fa-f]')
                     THEN chr(CAST('0x' || substr(x, 1, 2) AS INT)) || substr(x, 3) ELSE '%' || x END)), 'string_agg', '') AS plain FROM p),
        t AS (SELECT *, regexp_replace(translate(plain, '{_UPPER}', '{_LOWER}'), '([^a-z0-9])', '\1\1', 'g') AS body FROM d),
        n AS (SELECT i, term, points, len(regexp_extract_all(body, pattern)) AS n FROM t, term),
        c AS (SELECT i, coalesce(sum(n) FILTER (points IS NULL), 0) AS strict_hits, coalesce(sum(n) FILTER (points IS NOT NULL), 0) AS soft_hits,
                     count(*) FILTER (points IS NOT NULL AND n > 0) AS soft_terms, coalesce(sum(points) FILTER (n > 0), 0) AS points FROM n GROUP BY i)
        SELECT page_id, host, path, {case("name")} AS rule,
               coalesce({case("verdict")}, CASE WHEN strict_hits > 0 OR (soft_terms >= 2 AND points >= {LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
               CAST(strict_hits AS BIGINT) AS strict_hits, CAST(soft_hits AS BIGINT) AS soft_hits, soft_terms, CAST(points AS BIGINT) AS points
        FROM t JOIN c USING (i)
    """
