import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import licenses, tokens


def spans(df, docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    return sorted((r["doc_id"], r["license"], text[r["doc_id"]][r["begin"] : r["end"]], r["matched_words"], r["coverage"]) for r in df.collect())


def test_notices_are_found_where_they_stand(docs, rows):
    found = spans(licenses.scan(docs), docs)
    assert {(d, n, t) for d, n, t, _, _ in found} == {(r[0], "mit-notice", "Released under the MIT License" if "!!" not in r[1] else r[1][r[1].index("RELEASED") : r[1].index("LICENSE") + 7]) for r in rows if r[1] and "MIT LICENSE" in r[1].upper().replace("!!", "")}
    assert all(c == 1.0 for *_, c in found)


def full_alignment(template, text):
    """Most matches of a best local alignment, by the whole table."""
    h = np.zeros((len(template) + 1, len(text) + 1), int)
    for i, a in enumerate(template, 1):
        for j, b in enumerate(text, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=3, max_size=14), st.lists(st.integers(0, 5), min_size=1, max_size=20))
def test_band_as_wide_as_the_table_is_full_alignment(template, text):
    n, first, last = licenses.align(template, text, 0, 40)
    best = full_alignment(template, text)
    assert (n == 0) == (best == 0)
    assert 0 <= first <= last <= len(text)
    if n:
        assert 2 * n >= best


def test_edited_notices(spark):
    """Changed, left out and added words within the bound are found; other texts aren't."""
    rng, rows, want = random.Random(5), [], {}
    names = [n for n in licenses.TEMPLATES if len(licenses.TEMPLATES[n].split()) >= 12]
    for i in range(60):
        name = names[i % len(names)]
        w = licenses.TEMPLATES[name].split()
        k = rng.randrange(4, len(w) - 3)
        edited = [w[:k] + ["zzz"] + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + ["yyy", "xxx"] + w[k:], w][i % 4]
        rows.append((i, "noise words before here\n" + " ".join(edited) + "\nand after that"))
        want[i] = name
    rows += [(100, "the quick brown fox " * 50), (101, "license"), (102, "under the MIT")]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert all(want[i] in got.get(i, ()) or {want[i], *got[i]} <= {"gpl-2.0-notice", "gpl-3.0-notice"} for i in want)
    assert set(got) == set(want)


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(0)
    code, doc = rng.integers(0, 1 << 60, 200).astype(np.uint64), np.repeat([0, 1, 2, 3], [100, 90, 6, 4])
    _, kept = licenses.winnow(code, doc)
    kept = set(kept.tolist())
    for d in range(4):
        at = np.flatnonzero(doc == d)[: max(0, (doc == d).sum() - licenses.GRAM + 1)]
        for i in range(len(at) - licenses.WINDOW + 1):
            assert kept & set(at[i : i + licenses.WINDOW].tolist())


def test_edge_cases(empty, clashing, docs):
    assert licenses.scan(empty).count() == 0
    assert spans(licenses.scan(clashing), docs) == spans(licenses.scan(docs), docs)
    twice = licenses.scan(docs.union(docs))
    assert twice.count() == 2 * licenses.scan(docs).count()
    with pytest.raises(ValueError, match="fewer"):
        licenses.scan(docs, {"x": "two words"})


def test_tokens_are_runs_of_one_class():
    t = tokens.Tokens(["Ab1 ab.".encode(), b"", "é x".encode()])
    texts = ["Ab1 ab.".encode(), b"", "é x".encode()]
    assert [texts[d][b:e] for d, b, e in zip(t.doc, t.begin, t.end)] == [b"Ab", b"1", b"ab", b".", "é".encode(), b"x"]
    assert t.code[0] == t.code[2] and len(set(t.code.tolist())) == 5


def test_every_copy_of_a_short_notice_is_found(spark):
    """Copies on neighbouring lines, of one notice and of several."""
    short = [n for n in licenses.TEMPLATES if len(licenses.TEMPLATES[n].split()) <= 8]
    rows = [(10 * k + i, "\n".join([licenses.TEMPLATES[n]] * c)) for k, n in enumerate(short) for i, c in enumerate((2, 3, 40))]
    mixed = random.Random(1).choices(short, k=50)
    docs = spark.createDataFrame([*rows, (1000, " ".join(licenses.TEMPLATES[n] for n in mixed))], "doc_id long, text string")
    found = licenses.scan(docs).collect()
    assert len({(r["doc_id"], r["begin"]) for r in found}) == len(found) and all(r["coverage"] == 1 for r in found)
    for k, n in enumerate(short):
        assert [sum(r["doc_id"] == 10 * k + i and r["license"] == n for r in found) for i in range(3)] == [2, 3, 40]
    assert [r["license"] for r in sorted(found, key=lambda r: r["begin"]) if r["doc_id"] == 1000] == mixed


def test_edited_short_notices(spark):
    """One word in five changed, left out or added, in notices of 5 to 8 words and in long ones."""
    want = [("mit-notice", t) for t in ("Released under an MIT License", "Released under MIT License", "Released yyy under the xxx MIT License")]
    want += [("apache-2.0-notice", "Licensed under the Apache Software License, Version 2.0")]
    for name, template in licenses.TEMPLATES.items():
        w = template.split()
        count = len(tokens.Tokens([template.encode()], marks=False).code)
        edits = count - int(np.ceil(0.8 * count - 1e-9))
        plain = [i for i in range(1, len(w) - 1) if w[i].strip(",.").isalpha()]
        for shift in range(3):
            changed = set(plain[shift :: max(1, len(plain) // max(1, edits))][:edits])
            want.append((name, " ".join("zzz" if i in changed else x for i, x in enumerate(w))))
    df = spark.createDataFrame([(i, f"noise words before\n{t}\nand after") for i, (_, t) in enumerate(want)], "doc_id long, text string")
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    gpl = {"gpl-2.0-notice", "gpl-3.0-notice"}
    assert [t for i, (n, t) in enumerate(want) if not got.get(i, set()) & (gpl if n in gpl else {n})] == []


def brute_best(template, text):
    """``(score, matched words, first, last + 1)`` of a best local alignment, by the whole table with its paths."""
    best, cells = (0, 0, 0, 0), {}
    for i, a in enumerate(template):
        for j, b in enumerate(text):
            score, n, first = cells.get((i - 1, j - 1), (0, 0, None))
            if a == b:
                options = [(score + 2, n + 1, j if first is None else first)]
            else:
                options = [(score - 1, n, first)]
            options += [(c[0] - 1, *c[1:]) for c in (cells.get((i - 1, j)), cells.get((i, j - 1))) if c]
            top = max(options, key=lambda c: c[0])
            if top[0] > 0:
                cells[i, j] = top
                if a == b and top[0] > best[0]:
                    best = (*top, j + 1)
    return best


def test_matches_are_those_of_whole_tables(spark, docs, rows):
    """Every text against every template, without fingerprints or bands: one notice a text at most."""
    rng, made = random.Random(11), [(r[0], r[1] or "") for r in rows if len(r[1] or "") < 5000]
    for k, (name, template) in enumerate(sorted(licenses.TEMPLATES.items()) * 3):
        words = template.split()
        for _ in range(rng.randint(0, max(1, len(words) // 6))):
            words[rng.randrange(len(words))] = "zzz"
        made.append((1000 + k, f"Some text é here\n{' '.join(words)}\nand more after it"))
    index, want = licenses.TemplateIndex.build(licenses.TEMPLATES), []
    for i, text in made:
        data = text.encode()
        t = tokens.Tokens([data], marks=False)
        found = []
        for n, words in enumerate(index.words):
            _, matched, first, last = brute_best(words.tolist(), t.code.tolist())
            if matched >= licenses._least(words, licenses.MIN_COVERAGE):
                begin, end = (len(data[:x].decode()) for x in (int(t.begin[first]), int(t.end[last - 1])))
                found.append((i, index.names[n], begin, end, matched, matched / len(words)))
        want += [m for m in found if not any(o[5] > m[5] and o[2] <= m[2] and m[3] <= o[3] for o in found)]
    got = licenses.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 30


def test_long_texts_are_scanned_in_slices(spark, monkeypatch):
    rng = random.Random(2)
    parts = [rng.choice(["é noise words of no licence here", *licenses.TEMPLATES.values()]) for _ in range(400)]
    df = spark.createDataFrame([(1, "\n".join(parts))], "doc_id long, text string")
    text = "\n".join(parts).encode()
    index = licenses.TemplateIndex.build(licenses.TEMPLATES)
    key = lambda found: sorted(m[1:] for m in found)
    whole = key(licenses.matches_of(index, [text]))
    assert len(whole) > 200 and len(whole) == licenses.scan(df).count()
    monkeypatch.setattr(licenses, "OVERLAP", 4000)
    for size in (500, 3000):
        monkeypatch.setattr(tokens, "SLICE", size)
        assert key(licenses.matches_of_long(index, text)) == whole
    places = [m[3] for m in whole]
    assert licenses.code_points(text, places) == {p: len(text[:p].decode()) for p in places}
