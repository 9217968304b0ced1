"""License scanning by ordered signature rules.

Each rule is a pattern over the normalised words of a text with a label, a priority and
keywords; a rule is tried only where all its keywords occur. Where detections overlap,
one that lies inside another of higher priority is suppressed. The base phrases always
count, whatever the rules say.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Base phrases and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float


# Hand-written signatures: label; priority; confidence; patterns over lower-case words with one space between them.
_HAND_WRITTEN = """
mit; 60; .95; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; 50; .9; (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat) license
mit; 40; .8; mit licen[sc]ed?
mit; 40; .8; licen[sc]e mit
mit; 55; .9; spdx license identifier mit
mit; 45; .8; x11 license
mit; 35; .7; the expat license
mit-0; 60; .95; mit no attribution
apache; 60; .95; licensed under the apache license version [0-9 ]+
apache; 50; .9; apache software license
apache; 50; .9; apache licen[sc]e(?: version)? [0-9](?: [0-9])?
apache; 55; .9; spdx license identifier apache [0-9] [0-9]
apache; 45; .8; www apache org licenses
apache; 55; .9; you may not use this file except in compliance with the license
apache; 35; .6; asl 2 0
gpl; 60; .95; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl; 50; .9; gnu (?:general public license|gpl)(?: version [0-9])?
gpl; 50; .9; (?:version|v) ?[0-9](?: [0-9])? of the gnu general public license
gpl; 55; .9; spdx license identifier a?gpl [0-9](?: [0-9])?(?: only| or later)?
gpl; 45; .85; gpl (?:v )?v?[0-9](?: [0-9])?
gpl; 45; .8; gplv2
gpl; 45; .8; gplv3
gpl; 40; .7; under the gpl
lgpl; 70; .95; gnu (?:lesser|library) general public license
lgpl; 65; .9; (?:lesser|library) general public license
lgpl; 60; .9; lgpl (?:v )?v?[0-9](?: [0-9])?
lgpl; 60; .9; lgplv2
lgpl; 60; .9; lgplv3
agpl; 70; .95; gnu affero general public license
agpl; 65; .9; affero general public license
agpl; 60; .9; agpl (?:v )?v?[0-9](?: [0-9])?
agpl; 60; .9; agplv3
gpl-exception; 75; .9; general public license (?:version [0-9] )?with (?:the )?(?:classpath|linking|gcc runtime library) exception
bsd; 60; .95; redistribution and use in source and binary forms with or without modification are permitted
bsd; 60; .9; neither the name of .{1,80} nor the names of its contributors may be used to endorse
bsd; 50; .9; (?:0|1|2|3|4) clause bsd(?: license)?
bsd; 50; .9; (?:new|modified|revised|simplified|original) bsd license
bsd; 45; .85; bsd (?:0|1|2|3|4) clause
bsd; 40; .8; bsd (?:style )?license
isc; 60; .95; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc; 45; .85; isc license
zlib; 60; .95; this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib; 45; .85; zlib(?: libpng)? license
boost; 50; .9; boost software license(?: version [0-9] [0-9])?
mpl; 60; .95; this source code form is subject to the terms of the mozilla public license
mpl; 50; .9; mozilla public license(?: version)?(?: [0-9] [0-9])?
mpl; 45; .85; mpl [0-9] [0-9]
epl; 50; .9; eclipse public license(?: version| v)? ?[0-9]? ?[0-9]?
edl; 50; .9; eclipse distribution license
cddl; 50; .9; common development and distribution license
cpl; 50; .9; common public license
ipl; 50; .9; ibm public license
eupl; 50; .9; european union public licen[cs]e
eupl; 45; .85; eupl (?:v )?v?[0-9] [0-9]
cecill; 50; .9; cecill (?:free software )?licen[cs]e
artistic; 50; .9; artistic license(?: [0-9] [0-9])?
perl; 50; .85; same terms as perl itself
python; 50; .9; python software foundation license
python; 45; .85; psf license
ruby; 45; .85; ruby license
php; 45; .85; php license(?: version [0-9] [0-9]+)?
openssl; 45; .85; openssl license
postgresql; 45; .85; postgresql licen[cs]e
ncsa; 50; .9; university of illinois (?:ncsa )?open source license
wtfpl; 50; .9; do what the fuck you want to public license
wtfpl; 45; .85; wtfpl
unlicense; 60; .95; this is free and unencumbered software released into the public domain
unlicense; 40; .8; the unlicense
beerware; 45; .85; beer ?ware license
vim; 45; .8; vim license
curl; 45; .8; curl license
libpng; 45; .8; libpng license
ofl; 50; .9; sil open font license(?: version)?(?: [0-9] [0-9])?
ofl; 45; .85; ofl [0-9] [0-9]
ufl; 50; .9; ubuntu font licen[cs]e
gfdl; 70; .95; gnu free documentation license
gfdl; 45; .85; gfdl
odbl; 50; .9; open (?:data commons )?(?:open )?database license
odc-by; 50; .9; open data commons attribution license
pddl; 50; .9; public domain dedication and license
dbcl; 50; .9; database contents license
cdla; 50; .9; community data license agreement (?:permissive|sharing)
openrail; 50; .9; (?:creativeml |bigscience |bigcode )?openrail(?: m| [0-9]+)*(?: license)?
openrail; 50; .9; (?:creativeml |bigscience |bigcode )?open rail(?: m| [0-9]+)*(?: license)?
llama; 50; .85; llama [0-9]?(?: [0-9])? ?community license
gemma; 50; .85; gemma terms of use
ms-pl; 50; .9; microsoft public license
ms-rl; 50; .9; microsoft reciprocal license
osl; 50; .9; open software license(?: version)?(?: [0-9] [0-9])?
afl; 50; .9; academic free license(?: version)?(?: [0-9] [0-9])?
apsl; 50; .9; apple public source license
npl; 50; .9; netscape public license
qpl; 50; .9; q public license
sleepycat; 50; .9; sleepycat license
watcom; 50; .9; sybase open watcom public license
upl; 50; .9; universal permissive license
mulan; 50; .9; mulan (?:permissive software license|psl)
blueoak; 50; .9; blue oak model license
bsl; 50; .9; business source license(?: [0-9] [0-9])?
sspl; 50; .9; server side public license
elastic; 50; .9; elastic license(?: [0-9] [0-9])?
commons-clause; 50; .9; commons clause (?:license )?condition
polyform; 50; .9; polyform (?:noncommercial|small business|shield|perimeter|strict) license
jsl; 60; .9; the software shall be used for good not evil
public-domain; 40; .8; (?:dedicated|released|placed|donated) (?:in)?to the public domain
public-domain; 30; .6; this (?:work|file|software|code) is in the public domain
cc0; 60; .95; cc0 1 0(?: universal)?
cc0; 55; .9; creative commons zero
proprietary; 30; .7; all rights reserved
proprietary; 40; .8; proprietary and confidential
proprietary; 40; .8; confidential and proprietary
proprietary; 35; .7; unauthori[sz]ed copying
proprietary; 35; .7; unauthori[sz]ed reproduction
proprietary; 35; .7; unauthori[sz]ed distribution
proprietary; 35; .7; unauthori[sz]ed use
proprietary; 35; .7; may not be (?:copied|reproduced|redistributed|distributed) without (?:the )?(?:prior )?(?:written )?(?:permission|consent)
proprietary; 35; .7; end user licen[cs]e agreement
copyright; 20; .4; copyright (?:c )?(?:19|20)[0-9]{2}
notice; 20; .4; see (?:the )?licen[cs]e (?:file )?for (?:details|more information)
notice; 20; .4; subject to the (?:following )?(?:terms|conditions)
notice; 15; .3; provided as is without warranty
notice; 15; .3; without warranties or conditions of any kind
"""


def _words_of(pattern: str) -> tuple[str, ...]:
    """The plain words that any match must hold: the two longest outside groups and optional parts."""
    flat = re.sub(r"\\.|\[[^\]]*\][?*+]?|\.\{[^}]*\}|[a-z0-9 ]\?", "*", pattern)
    while re.search(r"\([^()]*\)", flat):
        flat = re.sub(r"\(\?:(?: [^()]*|[^()]* )\)[?*]", "", flat)  # optional whole words
        flat = re.sub(r"\([^()]*\)[?*+]?", "*", flat)
    plain = [w for w in re.split(r"[ ]", flat) if re.fullmatch(r"[a-z0-9]{2,}", w)]
    return tuple(sorted(plain, key=len, reverse=True)[:2])


def _creative_commons() -> Iterator[Rule]:
    """Every Creative Commons variant and version, by short and by long name."""
    long = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    for parts in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        label = "cc-" + "-".join(parts)
        for n, version in enumerate(("", " 1 0", " 2 0", " 2 5", " 3 0", " 4 0")):
            top = 40 + 5 * len(parts) + 3 * bool(n)
            yield Rule(label, "cc " + " ".join(parts) + version, ("cc", parts[-1]), top, 0.9)
            yield Rule(label, "(?:creative commons )" + " ".join(long[p] for p in parts) + "(?: international| unported| generic)?" + version, ("creative", "attribution"), top + 1, 0.9)
        yield Rule(label, r"creativecommons org licenses " + " ".join(parts) + r"(?: [0-9] [0-9])?", ("creativecommons", parts[-1]), 60 + len(parts), 0.95)


def _identifiers() -> Iterator[Rule]:
    """Short identifier lines for well-known licenses."""
    names = "afl agpl apache artistic bsd bsl cc cddl cecill cpl ecl edl efl epl eupl gfdl gpl ipl isc lgpl lpl lppl mit mpl ms naist ncsa ngpl nosl npl oclc odbl ofl ogl oldap openssl osl php postgresql psf python qpl rpl rpsl ruby sgi sissl spl sspl unlicense upl vim vsl w3c watcom wtfpl x11 xnet zend zlib zpl"
    for name in names.split():
        yield Rule(name, rf"spdx license identifier {name}(?: [0-9]+)*(?: only| or later)?", ("spdx", name), 57, 0.95)
        yield Rule(name, rf"licen[sc]e(?: type| name| id)? (?:is )?{name}(?: v?[0-9](?: [0-9])?)? licen[sc]e", (name,), 42, 0.8)


def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first; ties by label and pattern."""
    found = []
    for line in filter(None, _HAND_WRITTEN.splitlines()):
        label, priority, confidence, pattern = line.split("; ", 3)
        found.append(Rule(label, pattern, _words_of(pattern), int(priority), float(confidence)))
    return tuple(sorted([*found, *_creative_commons(), *_identifiers()], key=lambda r: (-r.priority, r.label, r.pattern)))


_RULES = rules()
_COMPILED = [(r, re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])".encode()), tuple(k.encode() for k in r.keywords)) for r in _RULES]
_BASE = [(re.compile(rf"(?<![^ ])(?={phrase}(?![^ ]))".encode()), phrase.split()[0].encode() + b" " + phrase.split()[1].encode(), label) for phrase, label in BASE.items()]


def _by_keyword() -> dict[bytes, list[int]]:
    """Rules by the one of their keywords that fewest rules have; a text meets only the rules of words it holds."""
    common = Counter(k for _, _, keys in _COMPILED for k in keys)
    index: dict[bytes, list[int]] = {}
    for i, (_, _, keys) in enumerate(_COMPILED):
        index.setdefault(min(keys, key=lambda k: (common[k], -len(k), k)), []).append(i)
    return index


_INDEX = _by_keyword()
#: Upper to lower case; ASCII that is neither letter nor digit to a space; all else stays.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """The words of the contract: runs of ASCII letters and digits, lower-cased, and of any non-ASCII characters."""
    return (text or "").encode().translate(_FOLD).split()


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    priority: int
    confidence: float
    base: bool


def detections(words: list[bytes], joined: bytes) -> list[Detection]:
    """Detections over words, placed by bytes of their joined form, overlaps resolved; base phrases first."""
    base = [Detection(m.start(), m.start() + len(p), label, 0, 0.9, True) for find, p, label in _BASE if p in joined for m in find.finditer(joined)]
    held = set(words)
    met = [_COMPILED[i] for word in _INDEX.keys() & held for i in _INDEX[word]]
    found = [Detection(m.start(), m.end(), r.label, r.priority, r.confidence, False) for r, find, keys in met if held.issuperset(keys) for m in find.finditer(joined)]
    kept: list[Detection] = []
    starts: list[int] = []  # of kept intervals that lie in no other one; their ends rise with them
    ends: list[int] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label, -d.confidence)):
        at = bisect_right(starts, d.start)
        if at and ends[at - 1] >= d.end:
            continue
        kept.append(d)
        low, high = bisect_left(starts, d.start), bisect_right(ends, d.end)
        starts[low : max(low, high)] = [d.start]
        ends[low : max(low, high)] = [d.end]
    return base + sorted(kept, key=lambda d: (d.start, d.end, d.label))


def scan_text(text: str | None) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score`` of one text."""
    words = normal_words(text)
    joined = b" ".join(words)
    found = detections(words, joined)
    base = [d for d in found if d.base]
    at = [d.start for d in base]
    places = [joined.count(b" ", 0, x) for x in ((min(at), max(at)) if at else ())]
    miss = 1.0
    for label in {d.label for d in found}:
        miss *= 1 - max(d.confidence for d in found if d.label == label)
    return (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({d.label for d in base})), ",".join(sorted({d.label for d in found})), round(1 - miss, 6))


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """License findings for every row of ``docs(doc_id, text)``, one row each.

    Null counts as empty: no words, no labels, score 0. ``first_word`` and ``last_word``
    are null where no base phrase stands. No shuffle; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = [scan_text(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def spans(docs: DataFrame) -> DataFrame:
    """The detections themselves: one row per detection, in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = normal_words(text.as_py())
                joined = b" ".join(words)
                first = seen = 0
                for d in sorted(detections(words, joined), key=lambda d: d.start):
                    first, seen = first + joined.count(b" ", seen, d.start), d.start
                    rows.append((key, d.label, first, first + joined.count(b" ", d.start, d.end) + 1, d.priority, d.base))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["doc_id", "label", "first_word", "end_word", "priority", "base"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, label string, first_word long, end_word long, priority int, base boolean")
