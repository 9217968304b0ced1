"""URL filter, word runs and phrases against SQL, brute force and hand-made cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tickgrid.llm import phrases, runs, urls

# --- URLs ---------------------------------------------------------------------------

URLS = [
    None, "", "://", "x", "casino", "HTTP://WWW.Example.COM/en/1?a=b", "http://example.com/en/", "http://example.com/en", "http://example.com", "http://a.b.example.com/en/x",
    "http://notexample.com/en/", "https://www.example.com/en/q", "https://x.www.example.com/en/q", "http://a.net/es/1", "http://net/fr/", "http://a.net/fr", "http://a.org/Casino",
    "http://a.org/casinos-royal", "http://a.org/occasion/casinò", "http://a.org/free", "http://a.org/free/free-free", "http://a.org/free-bets", "http://a.org/freebets", "http://a.org/click/deal",
    "http://a.org/click/deal/hot", "http://a.org/x%63asino", "http://a.org/%63asino#x", "http://a.org/#casino", "http://a.org/%zz%4", "http://a.org?casino://b/c", "http://a.org/adult-x9", "http://adult--x.org/",
    "http://a.org/" + "free-" * 20_000 + "bets", "http://xxx-xxx.org/xxx", "http://ä.org/ä?win=money&free", "http://a.com:80/en/", "http://u@example.com/en/\n2",
]


def _same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    want = con.sql(sql)
    assert df.columns == want.columns
    got, want = [tuple(r) for r in df.collect()], want.fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_urls_match_sql(spark):
    rows = [(i, u, 1, 2, "h") for i, u in enumerate(URLS)] + [(3, URLS[3], 1, 2, "h"), (None, URLS[16], 1, 2, "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, points long, c long, host string")
    pages = pd.DataFrame({"page_id": pd.array([r[0] for r in rows], "Int64"), "url": pd.array([r[1] for r in rows], "string")})
    got = {r[0]: r for r in _same(urls.filter_urls(df), urls.oracle_sql(), pages=pages)}
    verdict = {URLS[i]: r[3:5] for i, r in got.items() if i is not None}
    assert verdict["http://example.com/en/"] == ("example.com/en/", "block") and verdict["http://example.com"] == (None, "allow")
    assert verdict["https://x.www.example.com/en/q"] == ("www.example.com/en/", "allow") and verdict["http://notexample.com/en/"] == ("com/", "allow")
    assert [verdict[f"http://a.org/{p}"][1] for p in ("Casino", "free", "free/free-free", "free-bets", "freebets", "click/deal", "click/deal/hot", "#casino", "%63asino#x")] == [
        "block", "allow", "allow", "block", "allow", "allow", "block", "allow", "block"]
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_terms_by_plain_search():
    automaton = urls._automaton(("ab", "*b"), (("abc*", 5), ("b", 7)))
    text = "ab abc b-ab9 xb ab.b"
    assert Counter(urls.hits(text, automaton)) == Counter({("ab", None): 2, ("*b", None): 5, ("abc*", 5): 1, ("b", 7): 2})


# --- runs ---------------------------------------------------------------------------------


def _plain_runs(w, least=6, copies=4):
    found, n = [], len(w)
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size, own = j + q - i, w[i : j + q]
            if j > i and size >= max(least, copies * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_by_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        k = rnd.randint(1, 3)
        w = [rnd.randrange(k) for _ in range(rnd.randint(0, 40))]
        w[5:5] = [rnd.randrange(k) for _ in range(rnd.randint(1, 6))] * rnd.randint(0, 9)
        dense = [sorted(set(w)).index(x) for x in w]
        ends = [next((j for j in range(i + 1, len(w)) if dense[j:] < dense[i:]), len(w)) for i in range(len(w))]
        assert runs.lyndon_lengths(dense) == [j - i for i, j in enumerate(ends)]
        for least, copies in ((6, 4), (2, 2), (3, 3)):
            assert runs.runs_of(w, least, copies) == _plain_runs(w, least, copies)


def test_runs_of_long_texts():
    assert runs.runs_of(["a"] * 200_000) == [(0, 200_000, 1)]
    root = [str(i) for i in range(5_000)]
    assert runs.runs_of(["x", "x", *root * 5, "y"]) == [(2, 25_000, 5_000)]
    # Each cut makes one more word rare: what CUTS leave is worked on whole.
    stairs = [w for i in range(300) for w in (str(i), str(i), str(i), str(i + 1))]
    assert runs.runs_of(stairs) == _plain_runs(stairs)


def test_run_digests(spark):
    rnd = random.Random(7)
    texts = [None, "", " \t\n", "a", "é é é é é é 漢", "a b " * 4, "a b c d " * 3, "x" * 100_000, "w " * 60_000, "a a " * 7 + "b"] + [" ".join(rnd.choices("ab c", k=rnd.randint(0, 60))) for _ in range(60)] + [" ".join(rnd.choices(["a", "b"], k=40)) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1), (None, "a " * 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    want = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        if i is not None and w and zlib.crc32(str(i).encode()) % 10 == 0:
            g = zlib.crc32(str(i).encode()) // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        found = [(0, 60_000, 1)] if len(w) == 60_000 else _plain_runs(w)
        drop = {j for s, n, q in found for j in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in drop)).hexdigest()))
    assert sorted(map(tuple, runs.digests(df).collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[1] for r in want) > 20
    kept = {r.doc_id: (r.text, r.n_words, r.n_dropped) for r in runs.collapse_runs(df).collect()}
    assert kept[5] == ("a b", 8, 6) and kept[0] == ("", 0, 0) and kept[9][2] == 6
    assert [tuple(r) for r in runs.find_runs(df).filter("doc_id = 5").collect()] == [(5, 0, 8, 2)] * 2
    assert runs.digests(df.limit(0)).count() == 0


# --- phrases ----------------------------------------------------------------------------------


def test_summaries_lose_nothing_frequent():
    rnd = np.random.default_rng(1)
    for capacity in (5, 40, 4_000):
        summary, all_keys = phrases.MisraGries(capacity, 10), []
        for _ in range(30):
            keys = (rnd.zipf(1.3, 700) % 5_000).astype(np.uint32)
            all_keys.append(keys)
            summary.add(*np.unique(keys, return_counts=True))
        found, count = np.unique(np.concatenate(all_keys), return_counts=True)
        kept = set(summary.survivors().tolist())
        assert set(found[count >= 10].tolist()) <= kept <= set(found.tolist()) and summary.error < 10
        if capacity > 21_000 / 10:  # mass / threshold
            assert summary.capacity == capacity


def test_blocks_join_up(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 7)
    for text in (b"a bb ccc dddd eeeee ffffffffff g", b"x" * 50, b"x" * 20 + b" y", b"", b"a.b.c.d.e.f.g.h"):
        blocks = list(phrases._blocks(text))
        assert b"".join(blocks) == text and [w for b in blocks for w in b.replace(b".", b" . ").split()] == text.replace(b".", b" . ").split()


def test_phrases_match_sql(spark, monkeypatch):
    rnd = random.Random(3)
    prose = [" ".join(rnd.choices(["of", "the", "New", "york", "a.", "x,", "b\tc", "É", "é!", " "], [9, 9, 4, 4, 2, 2, 3, 1, 1, 1], k=rnd.randint(0, 90))) for _ in range(80)]
    texts = [None, "", " ", ".", "a", "A b;c\nd", "one two three " * 40, "t " * 800, "y" * 100_000, *prose]
    rows = [(i, t, rnd.choice(["en", "en", "de", None, "und"]), 1, 2) for i, t in enumerate(texts)] * 2 + [(None, "new york", "en", 1, 2)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, rank long, w1 long").repartition(5)
    documents = pd.DataFrame({"text": pd.array([r[1] for r in rows], "string"), "lang": pd.array([r[2] for r in rows], "string")})
    rows = _same(phrases.collocations(df), phrases.ORACLE_SQL, documents=documents)
    assert len(rows) > 100 and {r[0] for r in rows} == {"en", "de", "und"}
    # Small parts and shares: summaries overflow, tasks deal often, the last ranking sees several parts.
    monkeypatch.setattr(phrases, "HELD", 8_000)
    small = phrases.collocations(df, most=7, part_bytes=40_000).collect()
    assert sorted(map(tuple, small)) == sorted(r for r in rows if r[1] <= 7)
    assert phrases.collocations(df.limit(0)).count() == 0
