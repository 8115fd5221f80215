"""License scans by patience alignment of documents with notice templates.

Words that stand once in both texts are anchors; the longest increasing subsequence of
their places is kept, and the gaps between anchors are aligned in the same way. The
coverage of a template is the share of its words that are aligned. A notice is local, so a
document is aligned in windows of four template lengths that overlap by half; a window
without a common unique word but with enough words in common (a notice twice in a row)
is halved, down to one and a half template lengths.

A document is aligned with a template only where enough distinct words are in common,
which every alignment above the threshold needs. Texts are scanned in a map without
a shuffle; templates are a short list that goes to every task.

Templates are whole license texts and header notices (``notices``) and short sentences.
Of the passages of a template the one with the largest net number of words counts: aligned words
less words inserted between them and less words of the template that are missing. In
templates of up to ``HEADER`` words the words that tell versions and families apart
(numbers, ``MARKS``) must all be aligned, and none may be inserted. Templates whose
passages overlap compete by net words, so that a header inside a whole license text and
the near text of another version are not told as licenses of their own.

Defined cases: a null or empty text, or one without a notice, has a null license and
coverage 0; of several licenses the one with most net words is ``license``, among
equal ones the first name; repeated rows are scanned each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import row_slices, text_of

THRESHOLD = 0.85

HEADER = 150
MARKS = frozenset("affero lesser nc nd sa noncommercial noderivatives noderivs sharealike commercial derivatives share alike".split())

# Sentences that name a license, as they are commonly written.
SENTENCES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-long": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_FAMILIES = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
SENTENCES |= {f"cc-{k}-4.0{'-long' if k == 'by-nc' else ''}": f"This work is licensed under a Creative Commons {v} 4.0 International License." for k, v in _FAMILIES.items()}
SENTENCES |= {f"cc-{k}-4.0-short": f"Licensed under CC {k.upper()} 4.0." for k in _FAMILIES if k != "by-nc"}


def notices() -> dict[str, str]:
    """The texts of the folder ``notices`` by name."""
    files = resources.files(__package__).joinpath("notices").iterdir()
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files if f.name.endswith(".txt")}


TEMPLATES = SENTENCES | notices()

_WORD = re.compile(r"\w+")


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops, piles, before = [], [], []
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            piles.append(i)
        else:
            tops[pile], piles[pile] = value, i
    found, at = [], piles[-1] if piles else -1
    while at >= 0:
        found.append(at)
        at = before[at]
    return found[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Places (in the text, in the template) of aligned words, both increasing."""
    matched, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        if a >= b or c >= d:
            continue
        # Equal words at both ends of a gap need no anchor.
        if text[a] == template[c]:
            matched.append((a, c))
            gaps.append((a + 1, b, c + 1, d))
            continue
        if text[b - 1] == template[d - 1]:
            matched.append((b - 1, d - 1))
            gaps.append((a, b - 1, c, d - 1))
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: c + i for i, w in enumerate(template[c:d]) if theirs[w] == 1}
        common = [(a + i, place[w]) for i, w in enumerate(text[a:b]) if ours[w] == 1 and w in place]
        anchors = [common[i] for i in longest_increasing([y for _, y in common])]
        matched += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        if anchors:
            gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(matched)


class Template:
    def __init__(self, name: str, text: str, threshold: float):
        self.name, self.words = name, _WORD.findall(text.lower())
        self.needed = -(-len(self.words) * threshold // 1)
        self.distinct = Counter(self.words)
        # Distinct words that any alignment of enough words has at least.
        often = sorted(self.distinct.values(), reverse=True)
        self.least = next((i + 1 for i in range(len(often)) if sum(often[: i + 1]) >= self.needed), len(often))

    def passage(self, words: list[str], a: int, b: int) -> tuple[int, int, int, int]:
        """Net words, aligned words, first and last word of the passage that is aligned in ``words[a:b]``."""
        matched = align(words[a:b], self.words)
        if not matched:
            return (-len(self.words), 0, a, a - 1)
        first, last = a + matched[0][0], a + matched[-1][0]
        if len(self.words) <= HEADER:
            ours, theirs = {a + x for x, _ in matched}, {y for _, y in matched}
            told = lambda w: w in MARKS or w.isdecimal()
            if any(told(w) and i not in theirs for i, w in enumerate(self.words)) or any(told(words[i]) and i not in ours for i in range(first, last + 1)):
                return (-len(self.words), 0, a, a - 1)
        return (3 * len(matched) - (last - first + 1) - len(self.words), len(matched), first, last)

    def best(self, words: list[str]) -> tuple[int, int, int, int]:
        """Net words, aligned words, first and last word of the best passage with enough aligned words."""
        size, found = len(self.words), (-len(self.words), 0, 0, -1)
        span = 4 * size
        windows = [(s, min(s + span, len(words))) for s in range(0, max(len(words) - span // 2, 1), span // 2)]
        while windows:
            a, b = windows.pop()
            part = words[a:b]
            held = Counter(w for w in part if w in self.distinct)
            if sum(min(n, self.distinct[w]) for w, n in held.items()) < self.needed:
                continue
            here = self.passage(words, a, b)
            _, aligned, first, last = here
            if aligned and last - first >= aligned:
                # Chance words before or after a passage: as many words as the template has, from either end.
                here = max(here, *(self.passage(words, *w) for w in ((max(a, last + 1 - size), last + 1), (first, min(b, first + size)))), key=lambda p: (p[1] >= self.needed, p[0], -p[2]))
            net, aligned, first, last = here
            if aligned >= self.needed and (net, -first) > (found[0], -found[2]):
                found = here
            if (aligned < self.needed or 2 * (last - first + 1 - aligned) > size) and 2 * (b - a) > 3 * size:
                half = max((b - a) // 2 + size // 2, size)
                if half < b - a:
                    windows += [(a, a + half), (b - half, b)]
        return found


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.templates = [Template(n, t, threshold) for n, t in sorted(templates.items())]
        self.templates = [t for t in self.templates if t.words]

    def scan_all(self, text: str) -> list[dict]:
        """The licenses above the threshold with coverage and character span, most net words first."""
        lowered = text.lower()
        words = _WORD.findall(lowered)
        known = set(words)
        passages = []
        for t in self.templates:
            if len(t.distinct.keys() & known) < t.least:
                continue
            net, aligned, first, last = t.best(words)
            if aligned and aligned >= t.needed:
                passages.append((-net, t.name, aligned / len(t.words), first, last))
        kept = []
        for p in sorted(passages):
            if all(p[4] < q[3] or q[4] < p[3] for q in kept):
                kept.append(p)
        spans = [m.span() for m in _WORD.finditer(lowered)] if kept else []
        return [{"license": name, "coverage": coverage, "start": spans[a][0], "end": spans[b][1]} for _, name, coverage, a, b in kept]

    def scan(self, text: str) -> dict:
        """The first license of ``scan_all``."""
        return next(iter(self.scan_all(text)), {"license": None, "coverage": 0.0, "start": None, "end": None})


FOUND = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def find_licenses(df: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: key and ``licenses``, all that are found with coverage and span of their words in the lower-cased text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for part in row_slices(batches):
            found = [scanner.scan_all(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, FOUND)], names=["key", "licenses"])

    kind = df.schema[key].dataType.simpleString()
    each = "array<struct<license:string,coverage:double,start:bigint,end:bigint>>"
    return df.select(F.col(key).alias("key"), text_of(text).alias("_text")).mapInArrow(run, f"key {kind}, licenses {each}").withColumnRenamed("key", key)


def first_license(key: str = "doc_id") -> list[Column]:
    """Columns of ``find_licenses``: the key and the license with most net words."""
    first = F.get("licenses", F.lit(0))
    return [F.col(key), first["license"].alias("license"), F.coalesce(first["coverage"], F.lit(0.0)).alias("coverage"), first["start"].alias("start"), first["end"].alias("end")]


def scan_documents(df: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: key, ``license``, ``coverage``, and the span of its words in the lower-cased text."""
    return find_licenses(df, templates, key, text, threshold).select(*first_license(key))
