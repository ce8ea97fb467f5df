"""License scan: an exact set-similarity join of text blocks with license notices.

A block is any stretch of as many consecutive words as the template has, across lines too.  It meets the template
if it contains at least ``threshold`` of the template's different words.  Words are ordered by their frequency in
all documents, rarest first.  If a block holds ``need`` of a template's m words, it holds one of the m - need + 1
rarest (prefix filter), so only blocks around those are looked at.  A stretch around them must have ``need`` words
(length filter).  Inside it, a block that has met k words can only reach the threshold if k and the places left in it
come to ``need``, and if the words rarer than its rarest shared one leave ``need`` (position filter).  Blocks that pass
are compared word by word, so the result is exact.

Templates may be alike but for single words.  Of the templates of one family that blocks at overlapping places meet,
the one that holds best counts; each place is decided for itself.  Short templates need every word, next to each
other and in order, as "CC BY-NC" is another license than "CC BY" and its words may stand anywhere.

The templates are few and given by the caller, so the join's small side is an index in the task; the frequencies
are counted over the whole corpus for the words of the templates only.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import slices

# Base phrases with their labels, and notices of public licenses with theirs.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is "
     "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "apache"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
     "General Public License as published by the Free Software Foundation", "agpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation", "lgpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
     "and accompanying documentation covered by this license", "boost"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License", "epl"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
     "work", "cc0"),
)
# Names that stand for a license wherever their words stand next to each other.
NAMES = (
    ("GNU Affero General Public License", "agpl"), ("GNU Lesser General Public License", "lgpl"), ("Mozilla Public License", "mpl"),
    ("Eclipse Public License", "epl"), ("Boost Software License", "boost"), ("BSD License", "bsd"), ("ISC License", "isc"),
    ("The Unlicense", "unlicense"), ("creativecommons org publicdomain zero", "cc0"), ("Creative Commons Zero", "cc0"),
    ("CC0", "cc0"), ("CC 0 1.0", "cc0"),
)
# Identifiers of the SPDX list, a label each; after "SPDX-License-Identifier:" all of them count, and
# anywhere those with a version.
IDENTIFIERS = (
    ("MIT", "mit"), ("Apache-2.0", "apache"), ("GPL-2.0", "gpl"), ("GPL-3.0", "gpl"), ("LGPL-2.1", "lgpl"), ("LGPL-3.0", "lgpl"),
    ("AGPL-3.0", "agpl"), ("BSD-2-Clause", "bsd"), ("BSD-3-Clause", "bsd"), ("MPL-2.0", "mpl"), ("EPL-2.0", "epl"), ("ISC", "isc"),
    ("BSL-1.0", "boost"), ("Unlicense", "unlicense"), ("CC0-1.0", "cc0"),
)
CC_ELEMENTS = (
    ("nc", ("NC", "NonCommercial", "Non Commercial")),
    ("sa", ("SA", "ShareAlike", "Share Alike")),
    ("nd", ("ND", "NoDerivatives", "NoDerivs", "No Derivatives", "No Derivs")),
)
CC_LICENSES = ((), ("nc",), ("nc", "sa"), ("nc", "nd"), ("sa",), ("nd",))


def short_forms() -> list[tuple[str, str]]:
    """Creative Commons codes, names and addresses, and identifiers, with all spellings of the elements."""
    spelled = dict(CC_ELEMENTS)
    out = list(NAMES)
    for name, label in IDENTIFIERS:
        out.append((f"SPDX License Identifier {name}", label))
        if any(c.isdigit() for c in name):
            out.append((name, label))
    for elements in CC_LICENSES:
        label = "-".join(("cc-by", *elements))
        for way in product(*(spelled[e] for e in elements)):
            tail = " ".join(("", *way))
            out += [(f"Creative Commons {by}{tail}", label) for by in ("Attribution", "BY")]
            out += [(f"creativecommons org licenses by{tail}", label)]
            if elements:
                out.append((f"CC BY{tail}", label))
            else:
                # "CC by" alone says little.
                out += [(f"CC BY {version}", label) for version in range(1, 5)]
                out += [(f"{word} CC BY", label) for word in LICENSE_WORDS] + [(f"CC BY {word}", label) for word in LICENSE_WORDS]
                out += [("under a CC BY", label), ("under the CC BY", label)]
    return list(dict.fromkeys(out))


LICENSE_WORDS = ("under", "license", "licence", "licensed", "licenced", "licenses", "licences")
#: Short forms count word by word; of those at one place the longest does.
SHORT = frozenset(short_forms())
TEMPLATES = (*NOTICES, *short_forms())
#: Labels whose notices are alike but for single words.
FAMILIES = (
    frozenset(("cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nc-sa", "cc-by-nd", "cc-by-nc-nd")),
    frozenset(("gpl", "lgpl", "agpl")),
)

#: A-Z to a-z; 0-9, a-z and every byte of a character beyond ASCII stay; the rest separates words.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split(b" ") if text else []


@dataclass(frozen=True)
class Template:
    """``ranks``: the different words, rarest first, with their place; ``words`` are all, of a short form only."""

    label: str
    ranks: dict[bytes, int]
    need: int
    length: int
    words: tuple[bytes, ...] = ()


@dataclass(frozen=True)
class Match:
    """A stretch of words, end exclusive, that meets a template; of a notice the best of its blocks."""

    start: int
    end: int
    template: int
    share: float


@dataclass(frozen=True)
class Index:
    """Templates and, for every prefix word, the templates it leads to."""

    templates: tuple[Template, ...]
    prefixes: dict[bytes, list[int]]

    @staticmethod
    def build(templates, frequency: dict[bytes, int], threshold: float) -> "Index":
        built, prefixes = [], {}
        for text, label in templates:
            words = [w for w in words_of(text) if w]
            own = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
            short = (text, label) in SHORT
            need = len(own) if short else max(1, math.ceil(threshold * len(own) - 1e-9))
            for word in own[: len(own) - need + 1]:
                prefixes.setdefault(word, []).append(len(built))
            ranks = {w: i for i, w in enumerate(own)}
            built.append(Template(label, ranks, need, len(words), tuple(words) if short else ()))
        return Index(tuple(built), prefixes)

    def matches(self, words: list[bytes]) -> list[Match]:
        """Of every template and every run of blocks that meet it, the first of the best blocks."""
        places: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            for t in self.prefixes.get(word, ()):
                places.setdefault(t, []).append(at)
        found = []
        for t, hits in places.items():
            template = self.templates[t]
            if template.words:
                shift = template.words.index(words[hits[0]])
                for at in hits:
                    start = at - shift
                    if start >= 0 and tuple(words[start : start + template.length]) == template.words:
                        found.append(Match(start, start + template.length, t, 1.0))
            else:
                found += [Match(start, end, t, n / len(template.ranks)) for start, end, n in meeting_blocks(words, hits, template)]
        return found

    def rank(self, m: Match) -> tuple:
        template = self.templates[m.template]
        return not template.words, -m.share, -template.label.count("-") if template.words else 0, m.start - m.end

    def decided(self, found: list[Match]) -> list[Match]:
        """The matches without those that a better one of their family, or a longer short form, overlaps."""
        out = []
        for family in (*FAMILIES, None):
            own = [m for m in found if next((f for f in FAMILIES if self.templates[m.template].label in f), None) == family]
            if family is None:
                out += own
                continue
            # What is spelled out says more than a notice's share; then the better one, then that with more elements
            # ("under CC BY-NC" is no "CC BY"), then the longer one.
            own.sort(key=lambda m: (*self.rank(m), m.start, m.template))
            taken: list[Match] = []
            ends: list[tuple[int, int]] = []
            for m in own:
                at = bisect_right(ends, (m.start, math.inf))
                over = taken and ((at and ends[at - 1][1] > m.start) or (at < len(ends) and ends[at][0] < m.end))
                if over:
                    if (*self.rank(taken[-1]), taken[-1].start) != (*self.rank(m), m.start):
                        continue
                else:
                    ends.insert(at, (m.start, m.end))
                taken.append(m)
            out += taken
        return out


def meeting_blocks(words: list[bytes], hits: list[int], template: Template) -> Iterator[tuple[int, int, int]]:
    """``(start, end, different words)`` of the best block of each run of consecutive blocks that meet the template.

    Blocks of the template's length slide over the stretches around the prefix words.
    """
    reach, at = template.length - 1, 0
    while at < len(hits):
        low = max(0, hits[at] - reach)
        while at + 1 < len(hits) and hits[at + 1] - reach <= hits[at] + reach:
            at += 1
        high = min(len(words), hits[at] + reach + 1)
        at += 1
        # Length filter, and position filter: the words that are in the stretch at all, from the rarest one on.
        present = template.ranks.keys() & set(words[low:high]) if high - low >= template.need else ()
        if len(present) < template.need or len(template.ranks) - min(template.ranks[w] for w in present) < template.need:
            continue
        inside: dict[bytes, int] = {}
        best: tuple[int, int, int] | None = None
        for i in range(low, high):
            word = words[i]
            if word in template.ranks:
                inside[word] = inside.get(word, 0) + 1
            old = i - template.length
            if old >= low and words[old] in template.ranks:
                inside[words[old]] -= 1
                if not inside[words[old]]:
                    del inside[words[old]]
            if len(inside) >= template.need:
                if best is None or len(inside) > best[2]:
                    best = (max(low, old + 1), i + 1, len(inside))
            elif best is not None:
                yield best
                best = None
        if best is not None:
            yield best


def phrase_places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """``(first word, label)`` of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases:
        own = phrase.encode().split()
        last, at = own[-1], -1
        for _ in range(words.count(last)):
            at = words.index(last, at + 1)
            start = at - len(own) + 1
            if start >= 0 and words[start : at + 1] == own:
                out.append((start, label))
    return sorted(out)


def word_frequencies(docs: DataFrame, text_col: str, templates) -> dict[bytes, int]:
    """In how many documents each word of the templates occurs; as many numbers as the templates have words."""
    wanted = {w for text, _ in templates for w in words_of(text) if w}

    @F.arrow_udf("array<string>")
    def present(column: pa.Array) -> pa.Array:
        rows = [[w.decode() for w in wanted.intersection(words_of(t))] for texts in slices(column) for t in texts]
        return pa.array(rows, type=pa.list_(pa.string()))

    seen = docs.select(F.explode(present.asNondeterministic()(F.col(text_col))).alias("word"))
    return {r["word"].encode(): r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _scan(text: str, index: Index) -> dict:
    words = [w for w in words_of(text) if w]
    places = phrase_places(words)
    found = [] if index.prefixes.keys().isdisjoint(words) else index.decided(index.matches(words))
    base = sorted({label for _, label in places})
    starts = [at for at, _ in places]
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": base,
        "labels": sorted({*base, *(index.templates[m.template].label for m in found)}),
        "score": 1.0 if base else max((m.share for m in found), default=0.0),
    }


def scan_column(text: Column, index: Index) -> Column:
    longs = ("n_words", "n_base", "first_word", "last_word")
    texts_of = ("base_labels", "labels")
    kind = pa.struct(
        [(c, pa.int64()) for c in longs] + [(c, pa.list_(pa.string())) for c in texts_of] + [("score", pa.float64())]
    )

    @F.arrow_udf(", ".join([f"{c} long" for c in longs] + [f"{c} array<string>" for c in texts_of] + ["score double"]))
    def scanned(column: pa.Array) -> pa.Array:
        return pa.array([_scan(t, index) for texts in slices(column) for t in texts], type=kind)

    return scanned.asNondeterministic()(text)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per row of ``docs``: places of the base phrases, labels of both methods, and a score.

    ``labels`` adds those of every template that some block contains to at least ``threshold``; where blocks of one
    family overlap, the spelled-out, best, longest one counts, with ties all.  ``score`` is the best containment, 1 if a
    base phrase or a short form stands in the text, and 0 if nothing was met.  Null texts are empty; null and repeated
    ids stay; other columns are ignored; an empty table gives no row.  A text is read once, whatever its length.
    """
    index = Index.build(templates, word_frequencies(docs, text_col, templates), threshold)
    return docs.select(F.col(id_col).alias("doc_id"), scan_column(F.col(text_col), index).alias("s")).select("doc_id", "s.*")


def digest(scanned: DataFrame) -> DataFrame:
    """The labels comma-joined, from ``scan_licenses``."""
    return scanned.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
