"""License scan: ordered signature rules with a keyword prefilter and interval-containment suppression.

A text is matched as its lower-case words joined by single spaces.  Every rule names words of which
any match holds one; only rules with a word that stands in the text are tried.  Matches are taken in order
of priority, then length; one that lies within an accepted match is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, table, whole_ids
from .signatures import SIGNATURES

#: Fixed phrases that every scan reports, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_SEPARATORS = bytes(32 if not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else c for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: frozenset[bytes]
    pattern: re.Pattern
    priority: int
    score: float


#: Names: label, keywords (any match holds one), how the license is called, and its SPDX-style tag, in words.
NAMES = [
    ("mit", "mit expat", r"(?:the )?(?:mit|expat)", r"mit(?: 0)?"),
    ("apache-2.0", "apache", r"(?:the )?apache(?: software foundation)?(?: software)?(?: license)?(?: version)? v?2(?: 0)?", r"apache 2 0"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)?(?: license)?(?: version)? v?1 1", r"apache 1 1"),
    ("apache-1.0", "apache", r"(?:the )?apache(?: software)?(?: license)?(?: version)? v?1 0", r"apache 1 0"),
    ("gpl-1.0", "gnu", r"(?:the )?gnu (?:general public license|gpl)(?: version)? v?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gnu", r"(?:the )?gnu (?:general public license|gpl)(?: version)? v?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gnu", r"(?:the )?gnu (?:general public license|gpl)(?: version)? v?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "gnu", r"(?:the )?gnu (?:library|lesser) general public license(?: version)? v?2(?: 0)?(?! 1)", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "gnu", r"(?:the )?gnu (?:library|lesser) general public license(?: version)? v?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "gnu", r"(?:the )?gnu (?:library|lesser) general public license(?: version)? v?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "affero", r"(?:the )?(?:gnu )?affero general public license(?: version)?(?: v?3)?(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("gfdl-1.1", "gnu", r"(?:the )?gnu free documentation license(?: version)? v?1 1", r"gfdl 1 1(?: only| or later)?"),
    ("gfdl-1.2", "gnu", r"(?:the )?gnu free documentation license(?: version)? v?1 2", r"gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", "gnu", r"(?:the )?gnu free documentation license(?: version)? v?1 3", r"gfdl 1 3(?: only| or later)?"),
    ("bsd-2-clause", "bsd simplified freebsd clause", r"(?:the )?(?:simplified|freebsd|2 clause|two clause)(?: bsd)?|(?:the )?bsd (?:2|two) clause", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:new|modified|revised|3 clause|three clause) bsd|(?:the )?bsd (?:3|three) clause", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:original|4 clause|four clause) bsd|(?:the )?bsd (?:4|four) clause", r"bsd 4 clause"),
    ("0bsd", "bsd", r"(?:the )?(?:zero clause|0 clause|free public) bsd|(?:the )?bsd zero clause", r"0bsd"),
    ("isc", "isc", r"(?:the )?isc", r"isc"),
    ("mpl-1.0", "mozilla", r"(?:the )?mozilla public license(?: version)? v?1 0", r"mpl 1 0"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public license(?: version)? v?1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla", r"(?:the )?mozilla public license(?: version)? v?2(?: 0)?", r"mpl 2 0"),
    ("epl-1.0", "eclipse", r"(?:the )?eclipse public license(?: version)? v?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", "eclipse", r"(?:the )?eclipse public license(?: version)? v?2(?: 0)?", r"epl 2 0"),
    ("edl-1.0", "eclipse", r"(?:the )?eclipse distribution license(?: version)?(?: v?1(?: 0)?)?", r"edl 1 0"),
    ("cddl-1.0", "distribution", r"(?:the )?common development and distribution license(?: version)?(?: v?1 0)?", r"cddl 1 0"),
    ("cddl-1.1", "distribution", r"(?:the )?common development and distribution license(?: version)? v?1 1", r"cddl 1 1"),
    ("cpl-1.0", "common", r"(?:the )?common public license(?: version)?(?: v?1(?: 0)?)?", r"cpl 1 0"),
    ("eupl-1.1", "union", r"(?:the )?european union public licen[cs]e(?: version)? v?1 1", r"eupl 1 1"),
    ("eupl-1.2", "union", r"(?:the )?european union public licen[cs]e(?: version)? v?1 2", r"eupl 1 2"),
    ("artistic-1.0", "artistic", r"(?:the )?(?:perl )?artistic license(?: version)? v?1(?: 0)?", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"(?:the )?(?:perl )?artistic license(?: version)? v?2(?: 0)?", r"artistic 2 0"),
    ("bsl-1.0", "boost", r"(?:the )?boost software license(?: version)?(?: v?1(?: 0)?)?", r"bsl 1 0"),
    ("busl-1.1", "business", r"(?:the )?business source license(?: version)?(?: v?1 1)?", r"busl 1 1"),
    ("cc0-1.0", "cc0", r"(?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by-4.0", "commons", r"(?:the )?creative commons attribution(?: international)?(?: version)? 4 0(?: international)?", r"cc by 4 0"),
    ("cc-by-3.0", "commons", r"(?:the )?creative commons attribution(?: version)? 3 0(?: unported)?", r"cc by 3 0"),
    ("cc-by-sa-4.0", "commons", r"(?:the )?creative commons attribution share ?alike(?: version)? 4 0(?: international)?", r"cc by sa 4 0"),
    ("cc-by-sa-3.0", "commons", r"(?:the )?creative commons attribution share ?alike(?: version)? 3 0(?: unported)?", r"cc by sa 3 0"),
    ("cc-by-nc-4.0", "commons", r"(?:the )?creative commons attribution non ?commercial(?: version)? 4 0(?: international)?", r"cc by nc 4 0"),
    ("cc-by-nd-4.0", "commons", r"(?:the )?creative commons attribution no ?derivatives(?: version)? 4 0(?: international)?", r"cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "commons", r"(?:the )?creative commons attribution non ?commercial share ?alike(?: version)? 4 0(?: international)?", r"cc by nc sa 4 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl fuck", r"(?:the )?(?:wtfpl|do what the fuck you want to public license)(?: version)?(?: v?2)?", r"wtfpl"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?", r"zlib(?: acknowledgement)?"),
    ("python-2.0", "python", r"(?:the )?python software foundation license(?: version)?(?: v?2(?: 0)?)?", r"python 2 0|psf 2 0"),
    ("php-3.01", "php", r"(?:the )?php license(?: version)?(?: v?3 01)?", r"php 3 01?"),
    ("ruby", "ruby", r"(?:the )?ruby license", r"ruby"),
    ("ofl-1.1", "sil", r"(?:the )?sil open font license(?: version)?(?: v?1 1)?", r"ofl 1 1"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public license", r"ms pl"),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal license", r"ms rl"),
    ("postgresql", "postgresql", r"(?:the )?postgresql license", r"postgresql"),
    ("ncsa", "illinois", r"(?:the )?university of illinois(?: ncsa)? open source license", r"ncsa"),
    ("upl-1.0", "universal", r"(?:the )?universal permissive license(?: version)?(?: v?1 0)?", r"upl 1 0"),
    ("odbl-1.0", "database", r"(?:the )?open (?:data commons open )?database license(?: version)?(?: v?1 0)?", r"odbl 1 0"),
    ("sspl-1.0", "server", r"(?:the )?server side public license(?: version)?(?: v?1)?", r"sspl 1 0"),
    ("elastic-2.0", "elastic", r"(?:the )?elastic license(?: version)?(?: v?2(?: 0)?)?", r"elastic 2 0"),
    ("osl-3.0", "open", r"(?:the )?open software license(?: version)?(?: v?3(?: 0)?)?", r"osl 3 0"),
    ("afl-3.0", "academic", r"(?:the )?academic free license(?: version)?(?: v?3(?: 0)?)?", r"afl 3 0"),
    ("vim", "vim", r"(?:the )?vim license", r"vim"),
]
#: How a name is used: keywords where it isn't the name's, pattern, priority, score.
FORMS = [
    ("spdx", r"spdx license identifier {tag}", 90, 1.0),
    (None, r"(?:is |are |being )?(?:licensed|released|distributed|provided|available|published|covered)(?: to you)? under(?: the terms of)?(?: the)? {name}(?: licen[cs]e)?", 70, 0.95),
    (None, r"(?:licen[cs]e|licensing|licen[cs]ed)(?: is| under| type)? {name}(?: licen[cs]e)?", 60, 0.85),
    (None, r"{name}(?: public| software)? licen[cs]e", 50, 0.8),
    ("opensource", r"opensource org licenses {tag}", 80, 0.95),
    (None, r"{name}", 45, 0.75),
]
#: Sentences of the licenses themselves and generic notices: label, keywords, pattern, priority, score.
CLAUSES = [
    ("mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 100, 1.0),
    ("mit", "noninfringement", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", 95, 0.9),
    ("mit", "copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 95, 0.9),
    ("isc", "granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 100, 1.0),
    ("apache-2.0", "apache", r"licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license", 100, 1.0),
    ("apache-2.0", "licenses", r"(?:http|https)? ?(?:www )?apache org licenses license 2 0", 95, 0.95),
    ("gpl-2.0", "general", r"(?:gnu )?general public license as published by the free software foundation (?:either )?version 2", 100, 1.0),
    ("gpl-3.0", "general", r"(?:gnu )?general public license as published by the free software foundation (?:either )?version 3", 100, 1.0),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license as published by the free software foundation (?:either )?version 2 1", 101, 1.0),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license as published by the free software foundation (?:either )?version 3", 101, 1.0),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license as published by the free software foundation (?:either )?version 3", 101, 1.0),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public license along with this (?:program|library|software)", 60, 0.9),
    ("gpl", "free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 60, 0.9),
    ("lgpl", "lesser library", r"(?:gnu )?(?:lesser|library) general public license", 40, 0.8),
    ("gpl", "gnu", r"gnu (?:general public license|gpl)", 35, 0.75),
    ("gpl", "general", r"general public license", 20, 0.7),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 100, 0.95),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software", 100, 1.0),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg?ement", 100, 1.0),
    ("bsd", "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice", 90, 0.9),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e", 30, 0.7),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 100, 1.0),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 100, 1.0),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", 30, 0.7),
    ("epl", "eclipse", r"eclipse public licen[cs]e", 30, 0.7),
    ("apache", "apache", r"apache licen[cs]e", 30, 0.7),
    ("apache", "apache", r"apache software licen[cs]e", 31, 0.7),
    ("mit", "mit expat", r"(?:mit|expat) licen[cs]e", 30, 0.75),
    ("bsl-1.0", "boost", r"distributed under the boost software license version 1 0", 100, 1.0),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 100, 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 100, 1.0),
    ("cc0-1.0", "publicdomain", r"creativecommons org publicdomain zero 1 0", 100, 1.0),
    ("cc-by-4.0", "creativecommons", r"creativecommons org licenses by 4 0", 100, 1.0),
    ("cc-by-3.0", "creativecommons", r"creativecommons org licenses by 3 0", 100, 1.0),
    ("cc-by-sa-4.0", "creativecommons", r"creativecommons org licenses by sa 4 0", 100, 1.0),
    ("cc-by-sa-3.0", "creativecommons", r"creativecommons org licenses by sa 3 0", 100, 1.0),
    ("cc-by-nc-4.0", "creativecommons", r"creativecommons org licenses by nc 4 0", 100, 1.0),
    ("cc-by-nd-4.0", "creativecommons", r"creativecommons org licenses by nd 4 0", 100, 1.0),
    ("cc-by-nc-sa-4.0", "creativecommons", r"creativecommons org licenses by nc sa 4 0", 100, 1.0),
    ("cc", "commons", r"creative commons(?: attribution)?(?: licen[cs]e)?", 20, 0.5),
    ("public-domain", "domain", r"(?:placed|released|dedicated)(?: in| into| to)? the public domain", 60, 0.85),
    ("public-domain", "domain", r"(?:is |are )in the public domain", 50, 0.6),
    ("proprietary", "reserved", r"all rights reserved", 15, 0.3),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)", 55, 0.8),
    ("proprietary", "copying", r"unauthorized copying of this file via any medium is strictly prohibited", 90, 0.95),
    ("unknown-license", "license", r"see the (?:license file|file license|license txt)(?: for (?:details|more information|the full text))?", 15, 0.4),
    ("unknown-license", "license", r"use of this source code is governed by an? .{1,40}?licen[cs]e that can be found in the license file", 65, 0.6),
]


def rules() -> list[Rule]:
    """Every name in every form, and the hand-written clauses and signatures, highest priority first."""
    found = []
    for label, keyword, name, tag in NAMES:
        for own, form, priority, score in FORMS:
            if form == "{name}" and "licen" not in name:
                continue  # a word like a product's name says nothing by itself
            pattern = form.format(name=f"(?:{name})", tag=f"(?:{tag})")
            found.append(Rule(label, frozenset((own or keyword).encode().split()), re.compile(rf"(?<!\S){pattern}(?!\S)".encode()), priority, score))
    for label, keyword, pattern, priority, score in CLAUSES + SIGNATURES:
        found.append(Rule(label, frozenset(keyword.encode().split()), re.compile(rf"(?<!\S){pattern}(?!\S)".encode()), priority, score))
    return sorted(found, key=lambda r: -r.priority)


RULES = rules()
_BASE_WORDS = {p: p.split()[0].encode() for p in BASE}
KEYWORDS = frozenset().union(*(r.keywords for r in RULES), _BASE_WORDS.values())


def words(text: str | None) -> list[bytes]:
    """Lower-case words of a text: runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.encode().lower().translate(_SEPARATORS).split() if isinstance(text, str) else []


def scan(text: str | None) -> dict:
    """What a whole text says: base places, accepted detections (start, end, label, score; in words), labels and score."""
    w = words(text)
    here = KEYWORDS.intersection(w)
    out = {"n_words": len(w), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "detections": []}
    if not here:
        return out
    joined = b" ".join(w)
    base, labels, places = set(), set(), []
    for phrase, label in BASE.items():
        if _BASE_WORDS[phrase] in here:
            for m in re.finditer(rb"(?<!\S)(?=" + phrase.encode() + rb"(?!\S))", joined):
                places.append(m.start())
                base.add(label)
    taken: list[tuple[int, int, Rule]] = []
    begins: list[int] = []
    reach: list[int] = []  # the furthest end among accepted matches up to each begin
    live = [r for r in RULES if r.keywords & here]
    for priority in sorted({r.priority for r in live}, reverse=True):
        level = [(m.start(), m.end(), r) for r in live if r.priority == priority for m in r.pattern.finditer(joined)]
        end, fresh = -1, []
        for s, e, r in sorted(level, key=lambda x: (x[0], -x[1], x[2].label)):
            k = bisect_right(begins, s)
            if e > end and not (k and reach[k - 1] >= e):
                fresh.append((s, e, r))
                end = e
        if fresh:
            taken = sorted(taken + fresh, key=lambda x: x[:2])
            begins, reach = [x[0] for x in taken], list(accumulate((x[1] for x in taken), max))
    if not taken and not places:
        return out
    marks = sorted({*places, *(x for s, e, _ in taken for x in (s, e))})
    number, at, n = {}, 0, 0
    for x in marks:
        n += joined.count(b" ", at, x)
        number[x], at = n, x
    labels = base | {r.label for _, _, r in taken}
    starts = [number[x] for x in places]
    out |= {
        "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": max([0.7 if places else 0.0, *(r.score for _, _, r in taken)]),
        "detections": [(number[s], number[e] + 1, r.label, r.score) for s, e, r in sorted(taken, key=lambda x: x[:2])],
    }
    return out


SCHEMA = (
    "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<start:long,stop:long,label:string,score:double>>"
)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: see SCHEMA; ``detections`` are word intervals with label and score.

    Null text is empty: 0 words, null places, empty labels, score 0.  Of matches
    of equal priority that lie within each other the longest stays, of equal ones the first by label.  Repeated rows give repeated rows, an empty
    table an empty result; other columns are ignored.  A document is scanned where it is read.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([scan(t) for t in b["text"]], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
            names = ("start", "stop", "label", "score")
            out["detections"] = [[dict(zip(names, d, strict=True)) for d in row] for row in out["detections"]]
            yield out.assign(doc_id=b["doc_id"].to_numpy(), first_word=out["first_word"].astype("Int64"), last_word=out["last_word"].astype("Int64"))[
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
            ]

    return whole_ids(as_text(docs, id_col, text_col).mapInPandas(each, SCHEMA))


def op5(spark, sf_dir: str) -> DataFrame:
    """License mentions in every whole text of ``documents``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")
