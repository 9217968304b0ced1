"""The text operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from tickgrid.llm import bpe, chat, dedup, licenses, packing, pii, simhash, suffix, tiff, toxicity
from tickgrid.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, fp long, row long, samples string"
ODD = [
    None, "", " ", "a", "a b", "é 漢字 😀 ", "word " * 50_000, "x" * 100_000, "MIT License\n\tmit license", "Hello  World", "Hello\tWorld", "Hello World",
    "a@b.c_d@e.f 10.0.0.1 +1 (555) 123-4567 4111 1111 1111 1111", "<|endoftext|> \x1c don't", "1 " * 3000,
]


def _docs(spark, texts, first=0):
    """Texts with columns whose names clash with those the operators use inside, one row twice, and null ids."""
    rows = [(first + i, t, "en", 1, 2, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1] + [(None, "no id", "en", 1, 2, "x")] * 2, DOCS)


def _empty(spark):
    return spark.createDataFrame([], DOCS)


# --- chat -------------------------------------------------------------------------


def test_template_folds_and_marks():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if true and not false %}d{% else %}e{% endif %}"))
    assert tree == (chat.Emit(chat.Const("abcd")),)
    render = chat.compile_template(chat.TEMPLATE)
    pieces = list(render(iter([("user", "<turn x>"), ("assistant", "</turn>\\")])))
    assert "".join(p[1] for p in pieces) == "<turn user>\\<turn x\\></turn>\n<turn assistant>\\</turn\\>\\\\</turn>\n"
    assert [chat.unescape(p[1]) for p in pieces if p[2]] == ["</turn>\\"]


@pytest.mark.parametrize("bad", ["{{ a.__class__ | no }}", "{% import os %}", "{% for x in y %}{% endfor %}", "{{ 'a }}", "{% if a %}", "{{ f(a) }}",
    "{{ turn.text }}", "{% for t in turns %}{{ t.role == 'user' }}{% endfor %}", "{% for t in turns %}{{ u.text }}{% endfor %}", "{% for t in turns %}{% for u in turns %}{% endfor %}{% endfor %}", "{{ ('a' == 'b') | trim }}"])
def test_template_is_sandboxed(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_each_loop_sees_all_turns(spark):
    template = "{% for t in turns %}({{ t.text }}){% endfor %}|{% for t in turns %}{% if loop.first %}!{% endif %}{% generation %}{{ t.text }}{% endgeneration %}{% endfor %}."
    assert "".join(p[1] for p in chat.compile_template(template)(iter([("user", "a"), ("x", "b")]))) == "(a)(b)|!ab."
    df = spark.createDataFrame([(1, 0, "user", "a" * 2_000_000), (1, 1, "assistant", ""), (1, 2, "user", "b")], "conv_id long, turn long, role string, text string")
    rows = chat.format_conversations(df, template).orderBy("start").collect()
    assert "".join(r.formatted for r in rows) == "(" + "a" * 2_000_000 + ")()(b)|!" + "a" * 2_000_000 + "b."


def test_chat_round_trip(spark):
    rows = [(1, 2, "assistant", "ü</turn>"), (1, 1, None, None), (1, 2, "assistant", "ü</turn>"), (2, 0, "a>b\\", "\n"), (None, 0, "user", "x"), (3, None, "assistant", "")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}<") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, _, a, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


# --- SimHash ------------------------------------------------------------------------


def test_fingerprints_read_whole_texts(monkeypatch):
    text = " ".join(str(i) for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text) == whole
    assert simhash.fingerprint("A  b") == simhash.fingerprint("a B") != 0 and simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("limit", [0, 3, 64])
def test_links_keep_components(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(6)]
    prints = list({s ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for s in seeds for _ in range(40)})
    low = {p: p for p in prints}

    def root(p):
        while low[p] != p:
            p = low[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 2:
                a, b = root(p), root(q)
                low[max(a, b)] = min(a, b)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    got = {x.node: x.component for x in connected_components(edges).collect()}
    groups: dict = {}
    for p in prints:
        groups.setdefault(root(p), []).append(signed(p))
    assert got == {p: min(g) for g in groups.values() if len(g) > 1 for p in g}


def test_near_duplicates_edges(spark):
    got = simhash.near_duplicates(_docs(spark, ODD)).collect()
    assert len(got) == len(ODD) + 3
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == 0 and by[10].component_id == by[9].component_id
    assert by[None].component_id is None
    assert simhash.near_duplicates(_empty(spark)).count() == 0
    assert simhash.keep_one(_docs(spark, ODD)).columns == DOCS.replace(",", "").split()[::2]


# --- packing ---------------------------------------------------------------------------


def test_cut_and_configurations():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)] and packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]
    r = random.Random(1)
    for case in ({342: 300, 341: 600}, {600: 5, 424: 5, 1: 1}, {1: 1}, {}, {r.randrange(1, 1025): r.randrange(1, 50) for _ in range(200)}):
        plan = packing.configurations(case)
        held: dict = {}
        for config, times in plan:
            assert sum(k * n for k, n in config) <= 1024
            for k, n in config:
                held[k] = held.get(k, 0) + n * times
        assert held == case
        assert sum(t for _, t in plan) <= packing.best_fit(case, 1024).total()
    assert sum(t for _, t in packing.configurations({342: 300, 341: 600})) == 300


def _fewest(histogram: dict, capacity: int) -> int:
    """The fewest sequences, by trying all ways to fill one after the other."""
    from functools import lru_cache

    lengths = sorted(histogram, reverse=True)

    @lru_cache(maxsize=None)
    def fewest(left: tuple) -> int:
        if not any(left):
            return 0
        first = next(i for i, n in enumerate(left) if n)  # the longest piece left goes into the next sequence
        best = sum(left)

        def fill(i: int, room: int, now: tuple) -> None:
            nonlocal best
            if i == len(now):
                best = min(best, 1 + fewest(now))
                return
            for n in range(min(now[i], room // lengths[i]), -1, -1):
                fill(i + 1, room - n * lengths[i], now[:i] + (now[i] - n,) + now[i + 1 :])

        fill(0, capacity - lengths[first], left[:first] + (left[first] - 1,) + left[first + 1 :])
        return best

    return fewest(tuple(histogram[k] for k in lengths))


def test_plans_are_near_the_optimum():
    r = random.Random(11)
    for _ in range(40):
        case = {r.randrange(1, 25): r.randrange(1, 5) for _ in range(r.randrange(1, 5))}
        plan = sum(t for _, t in packing.configurations(case, 24))
        assert _fewest(case, 24) <= plan <= _fewest(case, 24) + 1


def test_program_reaches_the_bound_on_large_histograms():
    r = random.Random(12)
    case = {n: r.randrange(150, 250) * (3 if n < 300 else 1) for n in range(1, 1025)}
    plan, rest = packing.solve(case, 1024)
    total = plan.total() + packing.best_fit(rest, 1024).total()
    assert total <= -(-sum(k * n for k, n in case.items()) // 1024) + 1 and plan.total() > 0.9 * total


def test_packed_sequences_are_gapless(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD, *(f"text {i} " * (i % 90 + 1) for i in range(200))]
    rows = packing.pack_documents(_docs(spark, texts), path).collect()
    tok = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i})
        assert own == [(k, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n]))) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.05 * math.ceil(sum(r.length for r in rows) / 1024) + 1
    assert packing.pack_documents(_empty(spark), path).count() == 0


# --- licenses ------------------------------------------------------------------------------


def test_license_base_and_rules(spark):
    assert len(licenses.rules()) > 200 and all(r.keywords for r in licenses.rules())
    assert licenses.scan_text("GNU Lesser General Public License v2")[4:6] == ("gpl", "gpl,lgpl")
    assert licenses.scan_text("Licensed under CC BY-NC 4.0")[5] == "cc-by-nc"
    assert licenses.scan_text("the open sea at dawn")[5] == ""
    phrases = [(p.split(), label) for p, label in licenses.BASE.items()]
    texts = [*ODD, "emit license mit licenses", "The MIT  License. the Apache-license, general\npublic license", "mit license " * 500]
    got = {r.doc_id: r for r in licenses.scan(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for ws, label in phrases for k in range(len(words)) if words[k : k + len(ws)] == ws]
        at = [k for k, _ in hits]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(hits), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert licenses.scan(_empty(spark)).count() == 0


def _matching(pattern, r):
    """A random text that the pattern matches."""

    def make(items):
        out = ""
        for kind, value in items:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "IN":
                what, x = r.choice(value)
                out += chr(x if str(what) == "LITERAL" else r.randint(*x))
            elif kind == "ANY":
                out += r.choice("ab ")
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, body = value
                out += "".join(make(body) for _ in range(r.randint(low, min(int(high), low + 2))))
            elif kind == "BRANCH":
                out += make(r.choice(value[1]))
            else:
                assert kind == "SUBPATTERN"
                out += make(value[3])
        return out

    return make(re._parser.parse(pattern))


def test_license_rules_equal_running_all(spark):
    """Gate, priority and containment by definition: every rule is tried on every text, every pair of detections compared."""
    r = random.Random(8)
    rules = licenses.rules()
    texts = []
    for rule in rules:
        for _ in range(3):
            texts.append(_matching(rule.pattern, r))
            assert re.fullmatch(rule.pattern, texts[-1])
    for _ in range(300):
        parts = [_matching(r.choice(rules).pattern, r) for _ in range(r.randrange(1, 9))]
        texts.append(" ".join(r.choice((p, p.upper(), p.replace(" ", "-\n"), "gnu " + p, p + "x")) for p in parts))
    texts.append("word " * 200_000 + " ".join(texts))  # a very long text
    compiled = [(rule, re.compile(rf"(?<![^ ])(?:{rule.pattern})(?![^ ])")) for rule in rules]
    got: dict = {}
    for row in licenses.spans(_docs(spark, texts).filter("doc_id is not null").dropDuplicates(["doc_id"])).filter("not base").collect():
        got.setdefault(row.doc_id, []).append((row.first_word, row.end_word, row.label, row.priority))
    for i, t in enumerate(texts):
        joined = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)))
        if len(joined) > 100_000:  # pairs of all detections are too many there; the parts were compared one by one
            assert len(got[i]) > 1000
            continue
        found = sorted({(-rule.priority, m.start() - m.end(), m.start(), rule.label, m.end()) for rule, find in compiled for m in find.finditer(joined)})
        kept: list = []
        for d in found:
            if not any(k[2] <= d[2] and d[4] <= k[4] for k in kept):
                kept.append(d)
        word = lambda at: joined.count(" ", 0, at)
        assert sorted(got.get(i, [])) == sorted((word(s), word(e) + 1, label, -p) for p, _, s, label, e in kept), t


# --- BPE --------------------------------------------------------------------------------------


def test_lexicon_holds_its_words(tmp_path):
    r = random.Random(2)
    entries = {"".join(r.choice("abcé") for _ in range(r.randrange(1, 9))): [r.randrange(49000) for _ in range(r.randrange(1, 4))] for _ in range(3000)}
    (tmp_path / "x").write_bytes(bpe.compile_lexicon(entries))
    lexicon = bpe.Lexicon(str(tmp_path / "x"))
    assert all(lexicon.get(w) == ids for w, ids in entries.items())
    assert all(lexicon.get(w + "z") is None for w in entries)


def test_bpe_equals_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    r = random.Random(5)
    texts = [*ODD, "ΑΣ ΣΑΣ İI ẞ é", *("".join(chr(r.choice([r.randrange(1, 128), r.randrange(128, 0x2FFF), 32, 39])) for _ in range(100)) for _ in range(200))]
    docs = _docs(spark, texts)
    got = {x.doc_id: x for x in bpe.digests(docs, path).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(_empty(spark), path).count() == 0


# --- exact dedup -----------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [dedup.sha256, lambda body: F.length(body).cast("string")])
def test_exact_groups_equal_brute_force(spark, digest):
    docs = _docs(spark, [*ODD, *(f"t{i % 7}  x" for i in range(60))])
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.collect()]
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = sorted((str(i), str(min((x for x in groups[t] if x is not None), default=None)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    out = dedup.exact_groups(docs.repartition(3), files_per_batch=1, digest=digest).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    assert dedup.exact_groups(_empty(spark)).count() == 0


# --- TIFF -------------------------------------------------------------------------------------


def test_codecs_and_layouts():
    r = random.Random(1)
    for n in (0, 1, 10, 5000, 20000):
        for k in (1, 2, 256):
            d = bytes(r.randrange(k) for _ in range(n))
            assert tiff.unlzw(tiff.lzw(d), n) == d and tiff.unpackbits(tiff.packbits(d), n) == d
    pages = [np.frombuffer(r.randbytes(h * w), np.uint8).reshape(h, w) for h, w in ((1, 576), (70, 130), (33, 5))]
    for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for p in (False, True):
            for t in (False, True):
                read = list(tiff.read_tiff(tiff.write_tiff(pages, tiff.Layout(c, p, t))))
                assert all((a == b).all() for a, (_, b) in zip(pages, read, strict=True))


def test_big_endian_short_fields():
    fields = [(256, 3, 2), (257, 3, 2), (258, 3, 8), (259, 3, 1), (273, 4, 8), (278, 3, 2), (279, 4, 4)]
    body = b"MM\0*" + struct.pack(">I", 12) + bytes([1, 2, 3, 4]) + struct.pack(">H", len(fields))
    body += b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields) + b"\0\0\0\0"
    assert [p.tolist() for _, p in tiff.read_tiff(body)] == [[[1, 2], [3, 4]]]


def test_tiff_digests_and_pages(spark):
    docs = _docs(spark, ODD)
    got = {r.doc_id: r for r in tiff.digests(docs).collect()}
    for i, t in enumerate(ODD):
        data = tiff.payload(t)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(data[-32:]) and len(data) % 576 == 0
    pages = tiff.read_pages(tiff.store(docs)).filter("doc_id = 6").orderBy("page").collect()
    assert len(pages) == 2 and b"".join(p.samples for p in pages) == tiff.payload(ODD[6])
    assert tiff.digests(_empty(spark)).count() == 0


#: Strips that other programs wrote: LZW and PackBits (the examples of the format's description), and what they hold (fixed values).
PUBLISHED = {
    "lzw": (bytes.fromhex("80 01 E0 40 80 44 08 0C 06 80 80"), bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])),
    "packbits": (bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA"), bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")),
}


def test_published_strips():
    coded, plain = PUBLISHED["packbits"]
    assert tiff.unpackbits(coded, len(plain)) == plain and tiff.packbits(plain) == coded
    coded, plain = PUBLISHED["lzw"]
    assert tiff.unlzw(coded, len(plain)) == plain and tiff.lzw(plain) == coded


def test_damaged_media_are_rows_with_errors(spark):
    r = random.Random(4)
    pages = [np.frombuffer(r.randbytes(h * w), np.uint8).reshape(h, w) for h, w in ((3, 576), (70, 130))]
    whole = {c: tiff.write_tiff(pages, tiff.Layout(c, tiled=t)) for c, t in ((tiff.LZW, False), (tiff.DEFLATE, True), (tiff.PACKBITS, False))}
    media = [None, b"", b"GIF89a..", b"II*\0" + bytes(4), *whole.values()]
    for good in whole.values():
        media += [good[: r.randrange(len(good))] for _ in range(20)]
        for _ in range(60):
            bad = bytearray(good)
            bad[r.randrange(len(bad))] ^= 1 << r.randrange(8)
            media.append(bytes(bad))
    huge = bytearray(whole[tiff.LZW])
    at = struct.unpack_from("<I", huge, 4)[0] + 2
    struct.pack_into("<I", huge, at + 8, 1 << 31)  # the width, the first field
    media.append(bytes(huge))
    rows = spark.createDataFrame(list(enumerate(media)), "doc_id long, media binary")
    got: dict = {}
    for p in tiff.read_pages(rows).orderBy("doc_id", "page").collect():
        got.setdefault(p.doc_id, []).append(p)
    assert sorted(got) == list(range(len(media)))
    for i in (0, 1, 2, 3, len(media) - 1):
        assert [(p.page, p.samples) for p in got[i]] == [(0, None)] and got[i][0].error
    for i in (4, 5, 6):
        assert [p.samples for p in got[i]] == [p.tobytes() for p in pages] and all(p.error is None for p in got[i])
    for found in got.values():
        assert [p.page for p in found] == list(range(len(found))) and all((p.error is None) == (p.samples is not None) for p in found)
        assert all(p.error is None for p in found[:-1])


# --- toxicity ------------------------------------------------------------------------------------


def test_toxicity_holds_out_and_tolerates_gaps(spark):
    r = random.Random(4)
    plain = ["".join(r.choice(["ti", "on", "re", "sh", "an", "the", "le"]) for _ in range(r.randrange(1, 4))) for _ in range(400)]
    bad = ["idiot", "worthless", "moron"]
    toxic = [int(i % 5 == 0) for i in range(400)]
    texts = [" ".join(r.choices(plain, k=40) + [r.choice(bad) for _ in range(3 * t)]) + "." for t in toxic]
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.classify(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(400))
    assert sum(got[i].predicted == toxic[i] for i in held) >= 0.95 * len(held)
    model = toxicity.fit(docs, labels)
    marks = toxicity.margins([toxicity._folded(w) for w in ("idiot", "idi-ot", "idixot", "tionre")], model["beta"], model["bias"])
    assert min(marks[:3]) > marks[3]
    assert toxicity.classify(_empty(spark), labels).count() == 0
    assert {x.predicted for x in toxicity.classify(_docs(spark, ODD[:6]), labels.limit(0)).collect()} == {0}
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 2


# --- PII ---------------------------------------------------------------------------------------------

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(s: str) -> bool:
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0


def _plain_spans(text: str) -> list[tuple]:
    out = []
    for rank, (kind, pattern) in enumerate(_BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii_base_equals_plain_patterns(spark):
    r = random.Random(8)
    noise = ["".join(r.choice("0123456789 .-+@a%_()é") for _ in range(120)) for _ in range(300)]
    texts = [*ODD, "a@b.co x " * 3000, "+1 555 123 4567 é " * 500, *noise, "4111-1111-1111-1111", "é+33 6 12 34 56 78😀", "001.002.003.004 1.2.3.999", 'token = "abc123abc123abc" end']
    got = {x.doc_id: x for x in pii.spans(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = _plain_spans(t or "")
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))
    assert "secret:9:24" in got[len(texts) - 1].spans
    assert pii.spans(_empty(spark)).count() == 0
    red = pii.redact(_docs(spark, ["mail a@b.co now", None, "plain"]))
    assert {x.doc_id: x.text for x in red.collect()} == {0: "mail [email] now", 1: None, 2: "plain", None: "no id"} and red.columns[0] == "doc_id"


def test_redact_keeps_clashing_columns_and_long_texts(spark):
    long = "é" * 2500 + " a@b.co 10.0.0.1 " + "x" * 3000 + " c@d.ef"
    rows = [(0, "call +1 555 123 4567@x.de", "f", "p", "b"), (1, long, "f", "p", "b"), (2, "a@b.co " * 2000, "f", "p", "b")]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, found string, pii string, blocks string")).orderBy("doc_id").collect()
    assert [r[2:] for r in got] == [("f", "p", "b")] * 3
    assert got[1].text == "é" * 2500 + " [email] [ip] " + "x" * 3000 + " [email]"
    assert got[0].text == "call [phone]" and got[2].text == "[email] " * 2000


def test_pii_time_grows_with_the_text(spark):
    texts = ["a.aa.a@b.co " * 100_000, "1.2.3.4 " * 150_000, "+1 555 123 4567," * 60_000, "+1--" * 300_000, "1 " * 600_000]
    began = time.time()
    got = {r.doc_id: r for r in pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0].n_email, got[1].n_ip, got[2].n_phone, got[3].n_phone, got[4].n_card) == (100_000, 150_000, 60_000, 0, 0)
    assert time.time() - began < 90


def test_labeler_estimates_separate():
    patterns = [((1, 1, 1, 0), 50), ((1, 0, 1, 1), 30), ((-1, -1, 0, -1), 40), ((1, -1, 0, -1), 3)]
    found = pii.estimate(patterns)["posterior"]
    assert found[(1, 1, 1, 0)] > 0.9 > 0.1 > found[(-1, -1, 0, -1)]


# --- repeated passages ---------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [False, True])
def test_repeats_equal_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(suffix, "DEAL", 50)
        monkeypatch.setattr(suffix, "BUCKET", 300)
    r = random.Random(6)
    base = ["".join(r.choice("abc d") for _ in range(300)) for _ in range(8)]
    texts = [r.choice(base)[r.randrange(100) :][: r.randrange(20, 250)] + r.choice(base)[: r.randrange(120)] + str(i) * r.randrange(3) for i in range(60)]
    texts += [None, "", "x" * 49, "x" * 50, "x" * 51, "ab" * 40, "ba" * 40, "é" * 60, texts[3]]
    rows = [(i, t, "en", 1, 2, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (7, "y" * 60, "", 0, 0, ""), (None, "ab" * 40, "", 0, 0, "")], DOCS).repartition(5)
    all_rows = sorted(((1 << 63) - 1 if x.doc_id is None else x.doc_id, (x.text or "").encode()) for x in docs.collect())
    first: dict = {}
    for i, b in all_rows:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = []
    for i, b in all_rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = sorted(((1 << 63) - 1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.remove_repeats(docs).collect())
    assert got == sorted(want)
    assert suffix.remove_repeats(_empty(spark)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[0] and sizes[4] == sizes[3]
    assert docs.filter("text rlike '[a-z]@[a-z0-9-]+[.][a-z]'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[4]
