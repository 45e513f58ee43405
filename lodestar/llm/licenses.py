"""License scan: ordered signature rules behind a prefilter that is derived from them, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are the runs of these bytes in the lower-cased text (A-Z only): digits, a-z and everything beyond ASCII; others are blanks.
_CLASS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, pattern of the license's name as words with single spaces, and its pattern of versions ("" if none).
FAMILIES = (
    ("mit", r"(?:the )?mit(?: x11| expat)?", ""), ("mit-0", r"mit (?:0|no attribution)", ""), ("x11", r"x11(?: license)?", ""), ("expat", r"expat", ""),
    ("apache-1.1", r"apache(?: software)?", r"1 1"), ("apache-2.0", r"apache(?: software)?", r"2(?: 0)?"), ("apache", r"apache(?: software)?", ""),
    ("gpl-1.0", r"(?:gnu )?(?:general public|gpl)", r"1(?: 0)?"), ("gpl-2.0", r"(?:gnu )?(?:general public|gpl)", r"2(?: 0)?"), ("gpl-3.0", r"(?:gnu )?(?:general public|gpl)", r"3(?: 0)?"), ("gpl", r"gnu (?:general public|gpl)", ""),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public|lgpl)", r"2(?: 0)?"), ("lgpl-2.1", r"(?:gnu )?(?:lesser general public|lgpl)", r"2 1"), ("lgpl-3.0", r"(?:gnu )?(?:lesser general public|lgpl)", r"3(?: 0)?"), ("lgpl", r"(?:gnu )?(?:lesser general public|library general public|lgpl)", ""),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public|agpl)", r"3(?: 0)?"), ("agpl", r"(?:gnu )?(?:affero general public|agpl)", ""),
    ("bsd-2-clause", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)", ""), ("bsd-3-clause", r"(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd)", ""), ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd)", ""), ("bsd-0-clause", r"(?:0bsd|zero clause bsd|bsd zero clause)", ""), ("bsd", r"bsd", ""),
    ("mpl-1.1", r"(?:mozilla public|mpl)", r"1 1"), ("mpl-2.0", r"(?:mozilla public|mpl)", r"2(?: 0)?"), ("mpl", r"(?:mozilla public|mpl)", ""),
    ("epl-1.0", r"(?:eclipse public|epl)", r"1(?: 0)?"), ("epl-2.0", r"(?:eclipse public|epl)", r"2(?: 0)?"), ("epl", r"eclipse public", ""),
    ("cddl-1.0", r"(?:common development and distribution|cddl)", ""), ("cpl-1.0", r"common public", ""), ("isc", r"isc", ""), ("zlib", r"zlib(?: libpng)?", ""), ("boost-1.0", r"boost(?: software)?", ""),
    ("artistic-1.0", r"artistic", r"1(?: 0)?"), ("artistic-2.0", r"artistic", r"2(?: 0)?"), ("artistic", r"(?:perl )?artistic", ""), ("unlicense", r"unlicense", ""), ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", ""),
    ("python-2.0", r"python(?: software foundation)?", ""), ("ruby", r"ruby", ""), ("php-3.01", r"php", ""), ("openssl", r"openssl", ""), ("postgresql", r"postgresql", ""), ("ofl-1.1", r"(?:sil )?open font", ""), ("eupl-1.2", r"(?:european union public|eupl)", ""),
    ("odbl-1.0", r"(?:open database|odbl)", ""), ("odc-by-1.0", r"(?:open data commons attribution|odc by)", ""), ("cdla-permissive", r"community data license agreement permissive", ""), ("openrail", r"(?:open ?rail(?: m)?|responsible ai)", ""),
    ("cc0-1.0", r"(?:cc0|cc zero|creative commons zero)", ""), ("cc-by", r"(?:cc by|creative commons attribution)", ""), ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", ""), ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", ""), ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)", ""),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", ""), ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)", ""),
)
# Names that are also other things. Acronyms name institutes and programs, words are ordinary ones: they need more around them.
ACRONYMS = ("mit", "x11", "bsd", "isc", "zlib")
WORDS = ("expat", "apache", "boost-1.0", "artistic", "python-2.0", "ruby", "php-3.01", "openssl", "postgresql", "cpl-1.0", "ofl-1.1", "odbl-1.0", "openrail", "epl", "mpl")
# How a text states a license: name, pattern around NAME, how sure it makes us, of which names (c clear, a acronyms, w words).
FORMS = (
    ("grant", r"(?:licensed|released|distributed|available|published|provided|covered|governed)(?: only)? under(?: the)?(?: terms of)?(?: the)? NAME(?: licenses?| agreement)?VERSION", 1.0, "ca"),
    ("grant", r"(?:covered|governed)(?: only)? by(?: the)?(?: terms of)?(?: the)? NAME(?: licenses?| agreement)?VERSION", 1.0, "ca"),
    ("grant", r"licensed(?: only)? under(?: the)?(?: terms of)?(?: the)? NAME(?: licenses?| agreement)?VERSION", 1.0, "w"),
    ("grant", r"(?:released|distributed|available|published|provided|covered|governed)(?: only)? (?:under|by)(?: the)?(?: terms of)?(?: the)? NAME(?: licenses?| agreement)VERSION", 1.0, "w"),
    ("tag", r"spdx license identifier NAME(?: licenses?)?VERSION(?: only| or later)?", 1.0, "caw"),
    ("field", r"licen[cs]e(?: is| type| name)? (?:the )?NAMEVERSION", 0.8, "ca"),
    ("field", r"licen[cs]e(?: is| type| name) (?:the )?NAMEVERSION", 0.8, "w"),
    ("subject", r"(?:subject to|in accordance with|see|under)(?: the)?(?: terms of)?(?: the)? NAME(?: licenses?)?VERSION", 0.7, "ca"),
    ("subject", r"(?:subject to|in accordance with|see|under)(?: the)?(?: terms of)?(?: the)? NAME(?: licenses?)VERSION", 0.7, "w"),
    ("title", r"NAME licen[cs]es?(?: agreement)?VERSION", 0.9, "caw"),
)
PRIORITIES = {"passage": 100, "grant": 90, "tag": 80, "field": 70, "subject": 60, "title": 50}
# What follows when something else was named.
_ELSE = r"(?! (?:press|media|web|websites?|homepage|news|blog|lab|labs|laborator(?:y|ies)|universit(?:y|ies)|campus|imprint|brand|label|umbrella|foundation|conference|sloan|professors?|students?|researchers?|kernels?|sockets?|servers?|windows?|library|libraries|compression|format)(?![^ ]))"
_NOT_A_LICENSE = r"(?! (?:plates?|numbers?|holders?|fees?|exams?|tests?|renewals?)(?![^ ]))"
# Passages that say so without a name: label, pattern, keyword, how sure.
PASSAGES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission", 1.0),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose", "permission", 1.0),
    ("bsd", r"redistribution and use in source and binary forms", "redistribution", 1.0),
    ("bsd-3-clause", r"neither the name of (?:(?!neither the name of ).)+? may be used to endorse or promote", "endorse", 1.0),
    ("zlib", r"altered source versions must be plainly marked as such", "altered", 1.0),
    ("unlicense", r"free and unencumbered software released into the public domain", "unencumbered", 1.0),
    ("public-domain", r"(?:released (?:in)?to|in|dedicated to) the public domain", "domain", 0.8),
    ("mit", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions", "substantial", 1.0),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .{0,220}? to whom the software is furnished to do so the software is provided", "furnished", 0.9),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", "appear", 0.9),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice", "redistributions", 0.7),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledgement", "advertising", 1.0),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented", 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "implied", 0.9),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "compile", 1.0),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance", 0.9),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "writing", 1.0),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute", 1.0),
    ("gpl", r"you should have received a copy of the gnu general public license", "received", 1.0),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute", 1.0),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license", "received", 1.0),
    ("agpl", r"you should have received a copy of the gnu affero general public license", "received", 1.0),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "mozilla", 1.0),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "mozilla", 1.0),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse", 1.0),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license", "subject", 1.0),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "organization", 1.0),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "fee", 1.0),
    ("openssl", r"this product includes software developed by the openssl project", "openssl", 1.0),
    ("php-3.01", r"this product includes php software freely available from", "php", 1.0),
    ("python-2.0", r"psf is making python available to licensee on an as is basis", "psf", 1.0),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "package", 1.0),
    ("wtfpl", r"you just do what the fuck you want to", "fuck", 1.0),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", "font", 1.0),
    ("odbl-1.0", r"this .{1,80}? is made available under the open database license", "database", 1.0),
    ("cc0-1.0", r"has waived all copyright and related or neighbou?ring rights", "waived", 1.0),
    ("cc0-1.0", r"no rights reserved", "reserved", 0.6),
    ("creative-commons", r"this work is licensed under a creative commons", "commons", 0.9),
    ("eupl-1.2", r"licensed under the eupl", "eupl", 1.0),
    ("proprietary", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited", "prohibited", 1.0),
    ("proprietary", r"(?:may|must) not be (?:copied|reproduced|redistributed)(?: or (?:copied|reproduced|distributed))? without(?: the)?(?: express| prior)*(?: written)? (?:permission|consent)", "without", 0.7),
    ("proprietary", r"for internal use only", "internal", 0.5),
    ("proprietary", r"all rights reserved", "reserved", 0.5),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 0.9),
    ("copyright-notice", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 0.3),
)


def kind_of(label: str) -> str:
    return "a" if label in ACRONYMS else "w" if label in WORDS else "c"


class Rule(NamedTuple):
    label: str
    form: str
    needs: tuple[tuple[str, ...], ...]
    pattern: re.Pattern[str]
    priority: int
    sure: float


def expansions(pattern: str) -> list[str]:
    """All strings that a pattern of literals, [...], (?:...|...) and ? matches."""

    def alternatives(i: int) -> tuple[list[str], int]:
        out, seq = [], [""]
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                out, seq, i = out + seq, [""], i + 1
                continue
            if pattern.startswith("(?:", i):
                item, i = alternatives(i + 3)
                i += 1
            elif pattern[i] == "[":
                item, i = list(pattern[i + 1 : pattern.index("]", i)]), pattern.index("]", i) + 1
            else:
                item, i = [pattern[i]], i + 1
            if pattern[i : i + 1] == "?":
                item, i = [*item, ""], i + 1
            seq = [x + y for x in seq for y in item]
        return out + seq, i

    return alternatives(0)[0]


def hints(strings: Iterable[str]) -> tuple[str, ...]:
    """The least strings such that each given one holds one of them."""
    kept: list[str] = []
    for x in sorted(set(strings), key=lambda x: (len(x), x)):
        if not any(k in x for k in kept):
            kept.append(x)
    return tuple(kept)


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: passages, then for each form the families with a version before those without.

    A rule's needs follow from its pattern: of each of them, every match in " " + words holds at least one string.
    """
    out = [Rule(label, "passage", ((keyword,),), re.compile(rf"(?<![^ ]){p}(?![^ ])"), PRIORITIES["passage"], sure) for label, p, keyword, sure in PASSAGES]
    for form, around, sure, kinds in FORMS:
        before, after = around.replace("VERSION", "NAME").split("NAME")[:2]
        stated = hints(f" {x}" for x in expansions(before)) if before else hints(expansions(after))
        for label, name, version in FAMILIES:
            if kind_of(label) not in kinds:
                continue
            v = rf"(?: (?:v|version|ver) ?| ?){version}" if version else r"(?: (?:v|version)? ?\d(?: \d)?)?" if label.startswith("cc") else ""
            p = around.replace("NAME", f"(?:{name})").replace("VERSION", v)
            end = (_ELSE if label in ACRONYMS and form != "title" else "") + (_NOT_A_LICENSE if form == "title" or label in WORDS else "")
            needs = (hints(f" {x}" for x in expansions(name)), stated)
            out.append(Rule(label, form, needs, re.compile(rf"(?<![^ ]){p}(?![^ ]){end}"), PRIORITIES[form] + 5 * bool(version), sure))
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(1)
def by_need() -> tuple[tuple[tuple[str, ...], tuple[Rule, ...]], ...]:
    """The rules by the first of their needs, so that most are ruled out together."""
    out: dict[tuple[str, ...], list[Rule]] = {}
    for r in rules():
        out.setdefault(r.needs[0], []).append(r)
    return tuple((need, tuple(rs)) for need, rs in out.items())


class Detection(NamedTuple):
    label: str
    form: str
    first: int
    last: int
    priority: int
    sure: float


class Furthest:
    """The furthest end of intervals that begin at or before a place; each is added and asked for in logarithmic time."""

    def __init__(self, places: list[int]) -> None:
        self.places = sorted(set(places))
        self.ends = [-1] * (len(self.places) + 1)

    def add(self, first: int, last: int) -> None:
        i = bisect_left(self.places, first) + 1
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], last)
            i += i & -i

    def upto(self, first: int) -> int:
        i, out = bisect_right(self.places, first), -1
        while i:
            out = max(out, self.ends[i])
            i -= i & -i
        return out


def detect(words: str, blanks: list[int] | None = None) -> list[Detection]:
    """What the rules find in lower-cased words with single spaces: first and last word of each detection kept.

    Detections are taken by priority, then length, then place, then label; one that lies within a kept one goes.
    ``blanks`` are the places of the spaces, if they are known.
    """
    found, spaced, held = [], f" {words}", {}
    for need, some in by_need():
        if not any(h in spaced for h in need):
            continue
        for r in some:
            for n in r.needs[1:]:
                if n not in held:
                    held[n] = any(h in spaced for h in n)
            if all(held[n] for n in r.needs[1:]):
                for m in r.pattern.finditer(words):
                    if blanks is None:
                        blanks = [i for i, c in enumerate(words) if c == " "]
                    first = bisect_left(blanks, m.start())
                    found.append(Detection(r.label, r.form, first, first + m[0].count(" "), r.priority, r.sure))
    found.sort(key=lambda d: (-d.priority, d.first - d.last, d.first, d.label))
    reach = Furthest([d.first for d in found])
    kept: list[Detection] = []
    for d in found:
        if reach.upto(d.first) < d.last:
            reach.add(d.first, d.last)
            kept.append(d)
    return sorted(kept, key=lambda d: (d.first, d.last, d.label))


def scan(text: str) -> tuple[int, list[tuple[int, str]], list[Detection]]:
    """Number of words, base places (first word, label) and the rules' detections. Time is linear in the text and its detections' logarithm."""
    parts = text.encode("utf-8", "surrogatepass").translate(_CLASS).split()
    words = b" ".join(parts).decode("utf-8", "surrogatepass")
    blanks = None
    base = []
    for phrase, label in BASE:
        if phrase in words:
            blanks = [i for i, c in enumerate(words) if c == " "] if blanks is None else blanks
            base += [(bisect_left(blanks, m.start()), label) for m in re.finditer(rf"(?<![^ ])(?={phrase}(?![^ ]))", words)]
    return len(parts), sorted(base), detect(words, blanks)


def license_scan(docs: DataFrame) -> DataFrame:
    """Licenses that each whole text states: doc_id, n_words, base (array of word, label) and detections.

    Null or empty text: 0 words, empty arrays. Very long texts are read whole, in time that grows with their length. Null doc_ids and repeated rows are kept, an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    base_t = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found_t = pa.list_(pa.struct([("label", pa.string()), ("form", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scan(t.as_py() or "") for t in batch.column(1)]
            cols = [
                batch.column(0),
                pa.array([n for n, _, _ in out], pa.int64()),
                pa.array([[{"word": w, "label": x} for w, x in b] for _, b, _ in out], base_t),
                pa.array([[{"label": d.label, "form": d.form, "first": d.first, "last": d.last, "score": d.sure} for d in f] for _, _, f in out], found_t),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "base", "detections"])

    schema = "doc_id long, n_words long, base array<struct<word:long,label:string>>, detections array<struct<label:string,form:string,first:long,last:long,score:double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """The fixed report of ``license_scan``; score is one minus the product of what each place and detection leaves in doubt."""
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base = F.transform("base", lambda b: b["label"])
    doubt = F.aggregate(F.concat(F.transform("base", lambda b: F.lit(0.95)), F.transform("detections", lambda d: d["score"])), F.lit(1.0), lambda acc, s: acc * (1 - F.lit(0.95) * s))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda b: b["word"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["word"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"), F.round(1 - doubt, 6).alias("score"),
    )
