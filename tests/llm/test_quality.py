import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quern.llm import quality


def test_learner_follows_its_formulas():
    """One weight, by hand."""
    m = quality.FollowTheRegularisedLeader(4, alpha=0.5, beta=1, l1=0.1, l2=0.2)
    z = n = w = 0.0
    zc = nc = wc = 0.0
    for x, y in [(1.0, 1), (0.5, 0), (2.0, 1), (1.0, 1)]:
        p = 1 / (1 + math.exp(-(w * x + wc)))
        m.learn(np.array([2]), np.array([x]), y)
        for k, xx in ((0, x), (1, 1.0)):
            zz, nn, ww = (z, n, w) if k == 0 else (zc, nc, wc)
            g = (p - y) * xx
            s = (math.sqrt(nn + g * g) - math.sqrt(nn)) / 0.5
            zz, nn = zz + g - s * ww, nn + g * g
            ww = 0.0 if abs(zz) <= 0.1 else -(zz - math.copysign(0.1, zz)) / ((1 + math.sqrt(nn)) / 0.5 + 0.2)
            if k == 0:
                z, n, w = zz, nn, ww
            else:
                zc, nc, wc = zz, nn, wc if False else ww
        assert np.allclose([m.weights()[2], m.weights()[-1]], [w, wc])


def test_features_are_scaled_counts():
    texts = [b"a b a b a", b"", b"One two three! 12", "é è".encode()]
    doc, bucket, value = quality.features(texts)
    for d, n in ((0, True), (1, False), (2, True), (3, True)):
        assert math.isclose((value[doc == d] ** 2).sum(), 1.0, abs_tol=1e-5) if n else (doc != d).all()
    assert len(set(zip(doc.tolist(), bucket.tolist()))) == len(doc)
    alone = [quality.features([t]) for t in texts]
    assert [bucket[doc == d].tolist() for d in range(4)] == [b.tolist() for _, b, _ in alone]


def test_held_out_accuracy(docs, labels, rows):
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert set(got) == {r[0] for r in rows}
    truth = {r[0]: 0 if r[1] and "!!" in r[1] else 1 for r in rows}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    out = [i for i in got if got[i]["held_out"] and i < 90]
    assert sum(got[i]["predicted"] == truth[i] for i in out) >= 0.85 * len(out) > 5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_scores_are_dot_products(docs, labels):
    """The operator's scores are those of a dictionary of weights, one text at a time."""
    rows = quality.training_rows(docs, labels)
    w = quality.fit(rows)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, w).collect()}
    for r in docs.collect():
        _, b, v = quality.features([(r["text"] or "").encode()])
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-(sum(float(w[i]) * float(x) for i, x in zip(b, v)) + float(w[-1])))), abs_tol=1e-5)


def test_training_never_sees_held_out_labels(docs, labels):
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(quality.training_rows(docs, labels)) == quality.fit(quality.training_rows(docs, flipped))).all()
    assert len(quality.training_rows(docs, labels, most=10)) == 10


def test_edge_cases(docs, labels, empty, clashing):
    key = lambda df: sorted((r["doc_id"], round(r["score"], 6)) for r in df.collect())
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert key(quality.classify(clashing, labels)) == key(quality.classify(docs, labels))
    kept, scored = quality.keep_good(clashing, labels), {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["predicted"]}
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()} == scored
    twice = Counter(r["doc_id"] for r in quality.keep_good(docs.union(docs), labels).collect())
    assert set(twice.values()) <= {2}


def test_long_texts_are_counted_in_slices(monkeypatch, rows):
    """Features of slices with the words before are those of whole texts."""
    from quern.llm import tokens

    texts = [(r[1] or "").encode() for r in rows] + [b"", b"one", b"Word WORD word!! " * 300]
    whole = quality.features(texts)
    for size in (1, 9, 100):
        monkeypatch.setattr(tokens, "SLICE", size)
        monkeypatch.setattr(tokens, "cut_at", lambda text, at: (len(text) if at >= len(text) else next((i for i in range(at, len(text)) if text[i] in b" \n"), len(text))))
        for x, y in zip(whole, quality.features(texts)):
            assert np.allclose(x, y)


def test_memory_of_a_text_of_64_mb():
    import tracemalloc

    text = b"Some words of a text that goes on, and 7\n" * ((64 << 20) // 41)
    tracemalloc.start()
    quality.features([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
