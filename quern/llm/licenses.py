"""License scans: winnowed fingerprints find candidates, banded alignment measures them.

Templates are cut into word n-grams, of which winnowing keeps the least hash in each
window; an inverted index maps kept hashes to places in templates.  Documents are
winnowed alike, so any run of ``GRAM + WINDOW - 1`` words that a document shares with a
template shares a kept hash.  Wherever enough of a template's words stand close
together is looked at, too, as edits may leave no such run.  The text around hits is aligned,
and aligned again on both sides of each match, until nothing is left over.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import tokens
from ._shared import documents, lean, record_batches, utf8

#: Words of an n-gram, n-grams of a winnowing window, words more than a template's that a match may span on each side (or the template's number, if greater).
GRAM, WINDOW, BAND = 3, 3, 8
#: Share of a template's words that must match in order for a match to be reported.
MIN_COVERAGE = 0.8
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -1, -1

#: Bytes before and after a slice of a long text that are looked at with it: far more than a match spans.
OVERLAP = 1 << 16

#: Opening sentences of public licences (their own wording), and short notices in which authors name a
#: licence (``*-notice``: common forms of such lines, not the licences' own text).  Fixed values.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib-grant": "This software is provided 'as-is', without any express or implied warranty.",
}


def winnow(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept n-gram hashes and the place of their first word; documents with less than a window keep all."""
    total, at = tokens.grams(code, doc, GRAM)
    keep = np.zeros(len(total), bool)
    of = doc[at]
    if len(total) >= WINDOW:
        whole = np.flatnonzero(of[: len(of) - WINDOW + 1] == of[WINDOW - 1 :])
        least = np.stack([total[whole + i] for i in range(WINDOW)]).argmin(axis=0) if len(whole) else whole
        keep[whole + least] = True
    count = np.bincount(of, minlength=1)
    keep |= (count < WINDOW)[of]
    return total[keep], at[keep]


@dataclass
class TemplateIndex:
    """Templates' word hashes, and the inverted index of their winnowed n-grams."""

    names: list[str]
    words: list[np.ndarray]
    keys: np.ndarray
    places: list[list[tuple[int, int]]]

    @classmethod
    def build(cls, templates: dict[str, str]) -> TemplateIndex:
        names = sorted(templates)
        words = [tokens.Tokens([templates[n].encode()], marks=False).code for n in names]
        if short := [n for n, w in zip(names, words) if len(w) < GRAM]:
            raise ValueError(f"templates of fewer than {GRAM} words: {short}")
        found = defaultdict(list)
        for i, w in enumerate(words):
            for key, at in zip(*(x.tolist() for x in winnow(w, np.zeros(len(w), np.int64)))):
                found[key].append((i, at))
        keys = np.array(sorted(found), np.uint64)
        return cls(names, words, keys, [found[k] for k in keys.tolist()])


def align(template: list[int], text: list[int], diagonal: int, band: int, least: int = 0) -> tuple[int, int, int]:
    """Best local alignment of ``template[t]`` with ``text[p]`` for ``|p - t - diagonal| <= band``.

    ``(matched words, first matched place in the text, last + 1)``; of equally good ones the earliest end.
    Alignments of fewer than ``least`` matched words don't count.
    """
    # Cells hold (score, matches, first place); row by row over the template.
    above: dict[int, tuple[int, int, int]] = {}
    best = (0, 0, 0, 0)
    for t, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for p in range(max(0, t + diagonal - band), min(len(text), t + diagonal + band + 1)):
            score, matches, first = above.get(p - 1, (0, 0, p))
            hit = text[p] == word
            cell = (score + MATCH, matches + 1, first if matches else p) if hit else (score + MISMATCH, matches, first)
            for near in (above.get(p), row.get(p - 1)):
                if near and near[0] + GAP > cell[0]:
                    cell = (near[0] + GAP, near[1], near[2])
            if cell[0] > 0:
                row[p] = cell
                if hit and cell[0] > best[0] and cell[1] >= least:
                    best = (*cell, p + 1)
        above = row
    return best[1], best[2], best[3]


def _reach(words: int, band: int) -> int:
    """Words of text that a match spans at most: each one more than the template's costs ``GAP``."""
    return words + 2 * max(words, band)


def occurrences(template: list[int], text: list[int], band: int, least: int) -> list[tuple[int, int, int]]:
    """``(matched words, first, last + 1)`` of matches of ``least`` words or more that don't overlap,
    best first within twice the longest span, then what stands on both sides of each."""
    found, reach, wanted = [], _reach(len(template), band), Counter(template)
    todo = [(0, len(text))]
    while todo:
        at, stop = todo.pop()
        if stop - at < least:
            continue
        end = min(stop, at + 2 * reach)
        part = text[at:end]
        n = 0
        if (Counter(part) & wanted).total() >= least:
            n, first, last = align(template, part, 0, len(part) + len(template), least)
        if not n:
            if end < stop:  # what begins in the second half may end beyond it
                todo.append((end - reach, stop))
            continue
        if first < reach or end == stop:  # seen whole
            found.append((n, at + first, at + last))
            todo += [(at + last, stop), (at, at + first)]
        else:
            todo += [(at + first, stop), (at, at + first)]
    return found


def _regions(places: np.ndarray, doc: np.ndarray, least: int, reach: int) -> list[tuple[int, int]]:
    """First and last place of runs in which each ``least`` of ``places`` lie within ``reach`` of a document."""
    if len(places) < least:
        return []
    first, last = places[: len(places) - least + 1], places[least - 1 :]
    near = (last - first < reach) & (doc[first] == doc[last])
    return list(zip(first[near].tolist(), last[near].tolist()))


def matches_of_long(index: TemplateIndex, text: bytes, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> list[tuple[int, int, int, int, int]]:
    """As ``matches_of`` for one long text, slice by slice, each with what stands before and after it;
    a match belongs to the slice in which it begins."""
    kept: list[tuple[int, int, int, int, int]] = []
    at = 0
    while at < len(text):
        end = tokens.cut_at(text, at + tokens.SLICE)
        begin = tokens.cut_at(text, at - OVERLAP) if at > OVERLAP else 0
        stop = tokens.cut_at(text, end + OVERLAP)
        found = [(0, template, n, begin + i, begin + j) for _, template, n, i, j in matches_of(index, [text[begin:stop]], band, min_coverage)]
        kept += [m for m in found if at <= m[3] < end]
        at = end
    return kept


def code_points(text: bytes, places: list[int]) -> dict[int, int]:
    """The number of code points before each of the byte ``places``."""
    found, count, before = {}, 0, 0
    for p in sorted(set(places)):
        part = np.frombuffer(text, np.uint8, p - before, before)
        count += int(np.count_nonzero((part & 0xC0) != 0x80))
        found[p], before = count, p
    return found


def matches_of(index: TemplateIndex, texts: list[bytes], band: int = BAND, min_coverage: float = MIN_COVERAGE) -> list[tuple[int, int, int, int, int]]:
    """``(text, template, matched words, first byte, last byte + 1)`` for the matches in ``texts``."""
    t = tokens.Tokens(texts, marks=False)
    key, at = winnow(t.code, t.doc)
    slot = np.searchsorted(index.keys, key)
    slot[slot == len(index.keys)] = 0
    regions = defaultdict(list)
    for s, p in zip(*(x[index.keys[slot] == key].tolist() for x in (slot, at))):
        doc = int(t.doc[p])
        begin, end = np.searchsorted(t.doc, [doc, doc + 1]).tolist()
        for template in {template for template, _ in index.places[s]}:
            reach = _reach(len(index.words[template]), band)
            regions[doc, template].append((max(begin, p - reach), min(end, p + reach) - 1))
    # Edits may leave no kept n-gram: wherever enough of a template's words stand close together is looked at, too.
    known = np.unique(np.concatenate(index.words)) if index.words else np.empty(0, np.uint64)
    held = np.flatnonzero(np.isin(t.code, known))
    for template, words in enumerate(index.words):
        places = held[np.isin(t.code[held], words)]
        for first, last in _regions(places, t.doc, _least(words, min_coverage), _reach(len(words), band)):
            regions[int(t.doc[first]), template].append((first, last))
    found = []
    for (doc, template), spans in sorted(regions.items()):
        words, joined = index.words[template].tolist(), []
        for first, last in sorted(spans):
            if joined and first <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], last)
            else:
                joined.append([first, last])
        for first, last in joined:
            for n, i, j in occurrences(words, t.code[first : last + 1].tolist(), band, _least(words, min_coverage)):
                found.append((doc, template, n, int(t.begin[first + i]), int(t.end[first + j - 1])))
    return _undominated(index, found)


def _least(words, min_coverage: float) -> int:
    """Matched words from which a template's match is reported."""
    return max(1, int(np.ceil(min_coverage * len(words) - 1e-9)))


def _undominated(index: TemplateIndex, found: list[tuple]) -> list[tuple]:
    """Without matches that lie within a match of greater coverage (a version of the same notice)."""
    by_doc = defaultdict(list)
    for m in found:
        by_doc[m[0]].append((m[2] / len(index.words[m[1]]), m))
    kept = []
    for matches in by_doc.values():
        # By first byte and, of equal ones, longest first: what contains a match stands before it.
        matches.sort(key=lambda x: (x[1][3], -x[1][4], -x[0], x[1][1]))
        open_: list[tuple] = []
        for share, m in matches:
            open_ = [o for o in open_ if o[1][4] > m[3]]
            if not any(o[0] > share and o[1][4] >= m[4] for o in open_):
                kept.append(m)
            open_.append((share, m))
    return kept


def scan(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", band: int = BAND, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row for each match: ``id_col, license, begin, end, matched_words, coverage``.

    ``begin`` and ``end`` are code points of the text, ``end`` exclusive; ``coverage`` is the
    share of the template's words that match in order; a match within one of greater
    coverage is left out.  Words are runs of letters or of
    digits, A-Z lower-cased.  A text may match several templates, and one template at several places.
    Null, empty and unmatched texts give no row; texts of many MB are scanned slice by slice;
    repeated rows repeat theirs; other columns are not read.  No shuffle; the index of the templates, a few KB, goes to every task.
    """
    index = TemplateIndex.build(TEMPLATES if templates is None else templates)
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("matched_words", T.IntegerType()), T.StructField("coverage", T.DoubleType())])
    schema = to_arrow_schema(out)

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                for ids, texts in tokens.chunks(part.column(0).to_pylist(), utf8(part.column(1))):
                    long = [i for i, t in enumerate(texts) if len(t) > tokens.SLICE]
                    found = matches_of(index, [b"" if i in long else t for i, t in enumerate(texts)], band, min_coverage)
                    found += [(i, *m[1:]) for i in long for m in matches_of_long(index, texts[i], band, min_coverage)]
                    for doc in sorted({m[0] for m in found}):
                        mine = [m for m in found if m[0] == doc]
                        place = code_points(texts[doc], [p for m in mine for p in m[3:]])
                        for _, template, n, begin, end in mine:
                            yield ids[doc], index.names[template], place[begin], place[end], n, n / len(index.words[template])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") > 0).mapInArrow(lean(lambda batches: record_batches(rows(batches), schema)), out)


def op1_license_scan(spark, sf_dir) -> DataFrame:
    return scan(documents(spark, sf_dir))
