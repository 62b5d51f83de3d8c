"""License scans: exact phrases, and short notices with a bounded number of edits.

A text becomes its words, lower-cased and joined by single spaces. Each notice that may have k edits is split into k + 1 seeds: at least one stands
unharmed in any occurrence. An Aho-Corasick automaton finds all seeds in one pass; around each, the regex library looks for the whole notice
with at most k edits and reports its span. Exact phrases are found beside it by plain search.

One pass over whole texts, no shuffle. Defined results: a null or empty text has no words, places or labels and score 0; a repeated row is scanned
again; other columns are ignored; an empty table gives an empty result; of fuzzy spans of one notice that overlap, the one with fewest edits
stands, of equals the first.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm import textkit as tk

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Short notices, the label that each adds, and the edits (of characters) that it may have.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("licensed under the gnu general public license version 3", "gpl-3.0", 5),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("released under the mit license", "mit-notice", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-text", 7),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", 2),
    ("creative commons attribution", "creative-commons", 2),
    ("all rights reserved", "reserved", 1),
)
_JOINED = bytes(b if not tk._PLAIN[b] else 32 for b in range(256))


def seeds_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 parts of about equal length, with their offsets."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.cache
def _tools(notices: tuple) -> tuple:
    import ahocorasick
    import regex

    found: dict[str, list] = {}
    for k, (notice, _, edits) in enumerate(notices):
        for offset, seed in seeds_of(notice, edits):
            found.setdefault(seed, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for seed, uses in found.items():
        automaton.add_word(seed, (len(seed), uses))
    automaton.make_automaton()
    return automaton, [regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={edits}}}") for notice, _, edits in notices]


def _near(starts: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of starts that lie within so much of the run's first."""
    k = 0
    while k < len(starts):
        j = bisect.bisect_right(starts, starts[k] + most)
        yield starts[k], starts[j - 1]
        k = j


def _matches(pattern: re.Pattern, text: str, a: int, b: int) -> list:
    """The best match within a window, and those beside it."""
    todo, out = [(a, b)], []
    while todo:
        a, b = todo.pop()
        if m := pattern.search(text, a, b):
            out.append(m)
            todo += [(a, m.start()), (m.end(), b)]
    return out


def _apart(hits: list) -> list:
    """Of matches that overlap the one with fewest edits, of equals the first; in order."""
    kept: list = []
    for m in sorted(hits, key=lambda m: (sum(m.fuzzy_counts), m.start(), m.end())):
        at = bisect.bisect(kept, m.start(), key=lambda x: x.start())
        if (at == 0 or kept[at - 1].end() <= m.start()) and (at == len(kept) or m.end() <= kept[at].start()):
            kept.insert(at, m)
    return kept


def scan(text: bytes, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int, float]]]:
    """Number of words, places (word, label) of phrases, and spans (label, first word, end word, edits, likeness) of notices."""
    words = text.lower().translate(_JOINED).split()
    joined = b" " + b" ".join(words) + b" "
    gaps: list[np.ndarray] = []

    def word_at(spot: int) -> int:
        """The word that starts after, or holds, this spot; the gaps are listed once, and only for texts with a finding."""
        if not gaps:
            gaps.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32))
        return int(np.searchsorted(gaps[0], spot, "right")) - 1

    places = []
    for phrase, label in phrases:
        sought, spot = b" " + phrase.encode() + b" ", -1
        while (spot := joined.find(sought, spot + 1)) >= 0:
            places.append((word_at(spot), label))
    automaton, patterns = _tools(notices)
    flat = joined.decode("latin-1")
    starts: dict[int, set[int]] = {}
    for last, (length, uses) in automaton.iter(flat):
        for k, offset in uses:
            starts.setdefault(k, set()).add(last - length + 1 - offset)
    spans = []
    for k, found in starts.items():
        notice, label, edits = notices[k]
        hits = []
        for first, last in _near(sorted(found), 2 * edits):  # windows of bounded length: neighbours that may mean one occurrence
            hits += _matches(patterns[k], flat, max(0, first - edits), last + len(notice) + edits + 1)
        for m in _apart(hits):
            n, whole = sum(m.fuzzy_counts), m.group()
            first = word_at(m.start() + len(whole) - len(whole.lstrip()))
            spans.append((label, first, first + len(whole.split()), n, 1 - n / len(notice)))
    return len(words), places, spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,edits:int,likeness:double>>"


def scanned(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """A row per document: counts and labels of the phrases, labels of both, the best likeness, and the notices' spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("likeness", pa.float64())]))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for whole in batches:
            for batch in tk.slices(whole, "text"):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
                    n, places, spans = scan(text or b"", phrases, notices)
                    at, base = [p[0] for p in places], {p[1] for p in places}
                    score = 1.0 if places else max((s[4] for s in spans), default=0.0)
                    rows.append((doc_id, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), score, [dict(zip(("label", "first_word", "end_word", "edits", "likeness"), s)) for s in spans]))
                types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), kinds]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
