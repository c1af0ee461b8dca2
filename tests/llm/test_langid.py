import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import langid


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = langid.ByteNetwork.new(["a", "b", "c"], 1)
    x, y = rng.integers(1, 256, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(net.predict(x)[np.arange(5), y].astype(float)).mean()
    for name, g in zip(("e", "w", "b", "u", "c"), net.gradients(x, y)):
        p = getattr(net, name)
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)]:
            if name == "w" and net.mask()[at] == 0:
                assert g[at] == 0
                continue
            held, h = p[at], 1e-2
            p[at] = held + h
            up = loss()
            p[at] = held - h
            down = loss()
            p[at] = held
            assert abs((up - down) / (2 * h) - g[at]) < 2e-2


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=1000))
def test_windows_hold_the_whole_text(data):
    w = langid.windows_of(data)
    assert w.shape[1] == langid.WINDOW and w.tobytes()[: len(data)] == data and not any(w.tobytes()[len(data) :])
    assert len(w) == max(1, -(-len(data) // langid.WINDOW))


def test_accuracy_on_held_out_rows(docs, rows):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert set(got) == {r[0] for r in rows}
    lang = {r[0]: r[2] for r in rows}
    out = [i for i in got if got[i]["held_out"] and lang[i] and got[i]["lang_pred"] != "und"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i]["lang_pred"] == lang[i] for i in out) >= 0.9 * len(out) > 5
    n = len(rows) - 17
    for r in rows:
        undetermined = r[1] is None or not any(c.isalpha() for c in r[1])
        assert (got[r[0]]["lang_pred"] == "und") == undetermined and 0 <= got[r[0]]["score"] <= 1, n


def test_prediction_is_the_mean_over_all_windows(spark):
    net = langid.ByteNetwork.new(["a", "b"], 4)
    texts = ["x" * 10, "word " * 700, "é" * 300, "a"]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, t in enumerate(texts):
        data = t.encode()
        parts = [data[k : k + langid.WINDOW] for k in range(0, len(data), langid.WINDOW)]
        p = sum(net.predict(langid.windows_of(x))[0] * len(x) for x in parts) / len(data)
        assert abs(got[i]["score"] - p.max()) < 1e-5 and got[i]["lang_pred"] == net.classes[p.argmax()]


def test_edge_cases(spark, docs, empty, clashing):
    assert langid.identify(empty).count() == 0
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r[0] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()} == {"und"}
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 5)) for r in df.collect())
    assert key(langid.identify(clashing)) == key(langid.identify(docs))
    # Neither lang nor source is an input of a prediction, and rows are independent.
    net = langid.fit(docs)
    assert sorted(2 * key(langid.predict(docs, net))) == key(langid.predict(docs.union(docs), net))
    assert key(langid.predict(docs.drop("lang", "source"), net)) == key(langid.predict(docs, net))


def test_every_language_is_learnt(spark):
    """More languages than documents a language, and a bound on all documents together."""
    rows = [(10 * k + i, f"{chr(0x4E00 + k)} " * 30, f"l{k:03}") for k in range(230) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(df, total=460, windows=1)
    assert net.classes == [f"l{k:03}" for k in range(230)] and net.u.shape[1] == 230
