import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.components import component_labels


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    """fps: {id: fingerprint}; all pairs."""
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aAbé \n\t\x0b\x1c"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_fingerprint_is_spark_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ab c é d"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("ab c é d".encode(), 42)


def planted(seed, groups=12, each=14):
    """Chains and stars of fingerprints a few bits apart, and lone ones."""
    rng, found = np.random.default_rng(seed), []
    for g in range(groups):
        f = int(rng.integers(0, 1 << 63))
        for _ in range(each):
            found.append(f)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                f ^= 1 << int(b)
    return found + [int(x) for x in rng.integers(0, 1 << 63, 40)] + [0, 1, (1 << 64) - 1]


@pytest.mark.parametrize("tile_rows", [3, 40, None])
def test_links_connect_what_all_pairs_connect(spark, tile_rows):
    fps = dict(enumerate(dict.fromkeys(planted(1))))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()], "fp long, rep long")
    links = simhash.links_within(df, tile_rows=tile_rows)
    assert all((fps[r["a"]] ^ fps[r["b"]]).bit_count() == r["distance"] <= 4 for r in links.collect())
    label = {r["node"]: r["component"] for r in component_labels(links).collect()}
    assert {i: label.get(i, i) for i in fps} == brute_components(fps)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.integers(1, 2), st.sampled_from([0, 3, 20]), st.sampled_from([3, 1 << 20]), st.integers(0, 9))
def test_tiles_give_a_minimum_spanning_forest(n, words, radius, held, seed):
    rng, before = np.random.default_rng(seed), simhash.HELD_LINKS
    base = rng.integers(0, 1 << 63, (1 + n // 8, words), dtype=np.uint64)
    a = base[rng.integers(0, len(base), n)] ^ (np.uint64(1) << rng.integers(0, 64, (n, words), dtype=np.uint64))
    away = np.bitwise_count(a[:, None] ^ a[None]).sum(axis=2).astype(int)
    simhash.HELD_LINKS = held
    try:
        for b, first in ((None, 0), (a[n // 2 :], n // 2)):
            i, j, d = simhash.compare_tiles(a if b is None else a[: n // 2], b, radius)
            x, y = np.nonzero(np.triu(away, 1) <= radius) if b is None else np.nonzero(away[:first, first:] <= radius)
            x, y = (x[x < y], y[x < y]) if b is None else (x, y + first)
            assert (away[i, j] == d).all() and (d <= radius).all()
            # Prim's or Kruskal's forests have one length: found here by growing groups link by link.
            group, length, count = list(range(n)), 0, 0
            for w, p, q in sorted(zip(away[x, y].tolist(), x.tolist(), y.tolist())):
                if group[p] != group[q]:
                    group = [group[q] if g == group[p] else g for g in group]
                    length, count = length + w, count + 1
            assert (len(d), d.sum()) == (count, length)
    finally:
        simhash.HELD_LINKS = before


@pytest.mark.parametrize("tile_rows", [7, None])
def test_links_do_not_depend_on_the_order_of_rows(spark, tile_rows):
    """Many links of one length: which of them a forest takes is settled by the fingerprints, not by what arrives first."""
    fps = sorted({sum(1 << int(b) for b in rng.integers(0, 9, 3)) for rng in [np.random.default_rng(3)] for _ in range(300)})
    df = spark.createDataFrame([(f, f"{f:x}".encode()) for f in fps], "fp long, rep binary")
    found = []
    for seed in range(3):
        mixed = df.repartition(5).orderBy(F.rand(seed)).repartition(3 + seed)
        links = simhash.links_within(mixed, radius=3, tile_rows=tile_rows)
        thinned = simhash._thinned(links.orderBy(F.rand(seed)).repartition(2 + seed))
        found.append([sorted((bytes(r["a"]), bytes(r["b"]), r["distance"]) for r in t.collect()) for t in (links, thinned)])
    assert len(found[0][1]) >= len(fps) - 1 and found[0] == found[1] == found[2]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.sampled_from([0, 3, 20]), st.sampled_from([3, 1 << 20]), st.integers(1, 3), st.integers(0, 9))
def test_tiles_give_forests_without_a_common_link(n, radius, held, forests, seed):
    rng, before = np.random.default_rng(seed), simhash.HELD_LINKS
    base = rng.integers(0, 1 << 63, (1 + n // 8, 1), dtype=np.uint64)
    a = base[rng.integers(0, len(base), n)] ^ (np.uint64(1) << rng.integers(0, 64, (n, 1), dtype=np.uint64))
    away = np.bitwise_count(a[:, None] ^ a[None]).sum(axis=2).astype(int)
    simhash.HELD_LINKS = held
    try:
        i, j, d = simhash.compare_tiles(a, None, radius, forests)
    finally:
        simhash.HELD_LINKS = before
    x, y = np.nonzero(np.triu(away <= radius, 1))
    assert len({*zip(i.tolist(), j.tolist())}) == len(i) and (away[i, j] == d).all()
    # As long as forests of all pairs, taken away one after the other.
    lengths = [[len(p), int(w[p].sum())] for u, v, w in ((x, y, away[x, y]), (i, j, d)) for p in simhash.spanning_forests(u, v, w, n, forests)]
    assert lengths[:forests] == lengths[forests:] and sum(k for k, _ in lengths[:forests]) == len(d)


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = " ".join(f"w{i % 977}\t{i}" for i in range(3000)).encode()
    whole = simhash.fingerprint(text), simhash.shingle_set(text, 5).tolist()
    assert whole[0] == brute_fingerprint(text.decode())
    for size in (1, 7, 1000):
        monkeypatch.setattr(simhash, "SLICE", size)
        assert (simhash.fingerprint(text), simhash.shingle_set(text, 5).tolist()) == whole
    assert simhash.fingerprint(b"x" * 5000) == brute_fingerprint("x" * 5000)


def test_memory_of_a_text_of_64_mb():
    """In a process of its own, with all that it loads."""
    import subprocess
    import sys

    code = "import resource; from quern.llm import simhash; simhash.fingerprint(b'some words of a text that goes on 1\\n' * ((64 << 20) // 36)); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 600 << 10


def shingles_of(text, n=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_similar(rows, least=0.8):
    """Least id reachable over all pairs of Jaccard similarity ``least`` or more; and these pairs."""
    sets, parent, links = {r[0]: shingles_of(r[1]) for r in rows}, {r[0]: r[0] for r in rows}, []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(sorted(sets)):
        for j in sorted(sets)[n + 1 :]:
            x, y = sets[i], sets[j]
            if x == y or len(x & y) >= least * len(x | y) - 1e-9:
                links.append((i, j))
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, links


def test_links_beside_failing_ones(spark):
    """Families in which a text's closest neighbours by fingerprint are often not similar enough, and farther ones are."""
    rng, made = np.random.default_rng(11), []
    for family in range(12):
        base = [f"f{family}w{x}" for x in rng.integers(0, 500, 150)]
        for k in range(20):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 14)):
                words[at] = f"new{rng.integers(0, 1 << 30)}"
            made.append((1000 * family + k, " ".join(words)))
    want, links = brute_similar(made)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert all(want[got[i]] == want[i] for i in got)
    assert len(links) > 100 and sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)


def exact(spark, made, **given):
    want, links = brute_similar(made)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(made, "doc_id long, text string"), **given).collect()}
    assert got == want
    return links


def test_no_link_of_short_texts_is_missed(spark):
    """Fingerprints of few shingles differ in many bits, often more than the comparison of fingerprints goes to."""
    rng, made = np.random.default_rng(2), []
    for k in range(400):
        words = " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 8))
        made += [(2 * k, words), (2 * k + 1, f"{words} more")]
    described = [np.array([simhash.majority([s]), simhash.majority([simhash.mix(s)])], np.uint64) for s in (simhash.shingle_set(t.encode(), 5) for _, t in made)]
    apart = np.array([int(np.bitwise_count(x ^ y).sum()) for x, y in zip(described[::2], described[1::2])])
    assert (apart > simhash.SIMILAR_RADIUS).any()
    assert len(exact(spark, made)) == 400


@pytest.mark.parametrize("together,postings", [(4096, 1_000_000), (3, 50)])
def test_links_without_fingerprints(spark, monkeypatch, together, postings):
    """Families, chains, copies and frequent words: the rarest shingles alone find all that all pairs find, in small shares, too."""
    for name, value in (("TOGETHER", together), ("POSTINGS", postings), ("MET_ROWS", 40), ("STEP_PAIRS", 7)):
        monkeypatch.setattr(simhash, name, value)
    rng, made = np.random.default_rng(7), []
    often = " ".join(f"common{x}" for x in range(40))
    for family in range(8):
        words = [f"f{family}w{x}" for x in rng.integers(0, 500, 20 + 25 * family)]
        for k in range(12):
            if family % 2:  # a chain: each text unlike those far along it
                words = list(words)
                words[int(rng.integers(0, len(words)))] = f"new{rng.integers(0, 1 << 30)}"
                made.append((100 * family + k, " ".join(words)))
            else:
                changed = [w if rng.random() < 0.97 else f"new{rng.integers(0, 1 << 30)}" for w in words]
                made.append((100 * family + k, " ".join(changed)))
        made.append((100 * family + 50, made[-1][1]))
    made += [(1000 + k, f"{often} own{k} {often if k % 3 else k}") for k in range(30)] + [(2000, None), (2001, ""), (2002, "a"), (2003, "A")]
    assert len({i for pair in exact(spark, made, radius=0) for i in pair}) > 50


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 30), st.integers(1, 400), st.sampled_from([0.5, 0.8, 0.9, 1.0]), st.integers(0, 9))
def test_possible_pairs(n, most, similarity, seed):
    """Sets that share their first rare hash: no similar pair goes, and no pair of one component stays."""
    rng = np.random.default_rng(seed)
    hashes = rng.integers(0, 1 << 63, 2 * most, dtype=np.uint64)
    base = hashes[: rng.integers(1, most + 1)]
    sets = [np.unique(np.where(rng.random(len(base)) < 0.1 * rng.random(), rng.choice(hashes, len(base)), base)) for _ in range(n)]
    sets.sort(key=len)
    frequent = (np.sort(hashes[:5]), np.arange(3, 8))
    rare = [simhash.rarest(s, frequent, similarity).tolist() for s in sets]
    component, sketches = rng.integers(0, 6, n), simhash.Sketches([simhash.sketch(s) for s in sets])
    found = set()
    for h in {x for r in rare for x in r}:
        rows = np.array([k for k in range(n) if h in rare[k]])
        size, place = np.array([len(sets[k]) for k in rows]), np.array([rare[k].index(h) for k in rows])
        held = simhash.Sketches([simhash.sketch(sets[k]) for k in rows])
        one = np.zeros(len(rows), np.int64)
        i, j = simhash.possible_pairs(one, one, one == 0, size, place, component[rows], held, similarity)
        found |= {tuple(sorted((int(rows[a]), int(rows[b])))) for a, b in zip(i, j)}
    both = lambda x, y: len(np.intersect1d(x, y))
    pairs = [(x, y) for x in range(n) for y in range(x + 1, n) if component[x] != component[y]]
    assert {(x, y) for x, y in pairs if both(sets[x], sets[y]) >= similarity * len(np.union1d(sets[x], sets[y])) - 1e-9} <= found <= set(pairs)
    if pairs:
        i, j = np.array(pairs).T
        assert (sketches.apart(i, j) <= [len(np.setxor1d(sets[x], sets[y])) for x, y in pairs]).all()


def test_similar_documents(spark, docs, rows, clashing, empty):
    rng = np.random.default_rng(5)
    made = [tuple(r[:2]) for r in rows]
    for family in range(6):  # copies of one text with ever more words changed: similarities from 1 down to 0.4
        base = [f"f{family}w{x}" for x in rng.integers(0, 500, 120)]
        for k in range(12):
            words = list(base)
            for at in rng.integers(0, len(words), k):
                words[at] = f"new{rng.integers(0, 1 << 30)}"
            made.append((1000 + 20 * family + k, " ".join(words)))
    want, links = brute_similar(made)
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert len(got) == len(made)
    assert all(got[i] >= want[i] and want[got[i]] == want[i] for i in got)  # no link between what isn't linked
    unlike = [(i, j) for i, j in links if shingles_of(dict(made)[i]) != shingles_of(dict(made)[j])]
    assert len(unlike) > 40 and sum(got[i] == got[j] for i, j in unlike) >= 0.95 * len(unlike)
    assert all(got[i] == got[j] for i, j in links if (i, j) not in set(unlike))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(simhash.similar_documents(clashing)) == key(simhash.similar_documents(docs))
    assert simhash.similar_documents(empty).count() == 0
    kept = simhash.keep_one(clashing, find=simhash.similar_documents)
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_similar(rows)[0].values()))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    parent = list(range(26))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in component_labels(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for a, b in links if a != b for x in (a, b)}}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 2000).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    got = component_labels(chain.union(star)).groupBy("component").count().collect()
    assert sorted(map(tuple, got)) == [(0, 301), (1000, 1000)]


def test_documents(docs, rows, clashing, empty):
    want_fp = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want = brute_components(want_fp)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {i: (want_fp[i], want[i]) for i in want}
    assert len(got) == len(rows) and all(len(r["fingerprint"]) == 16 for r in got)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(simhash.near_duplicates(clashing)) == key(simhash.near_duplicates(docs))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "q r s t u v"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2), (3, 2)], key=str)
    assert sorted((r["doc_id"] for r in simhash.keep_one(df).collect()), key=str) == [1, 2, None, None]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.similar_documents(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2), (3, 2)], key=str)


def test_keep_one_of_any_columns(spark):
    """Names like the operator's own, and columns that have no order."""
    rows = [(1, "a b c d e", {"x": 1}, "k"), (1, "a b c d e", {"x": 1}, "k"), (2, "a b c d e", None, None), (None, "z", {}, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id map<string,int>, row string").withColumn("c0", F.lit(1))
    for find in (simhash.near_duplicates, simhash.similar_documents):
        kept = simhash.keep_one(df, find=find)
        assert kept.columns == df.columns and sorted((r["doc_id"] or 0, str(r["kept_id"]), r["row"]) for r in kept.collect()) == [(0, "{}", "r"), (1, "{'x': 1}", "k")]
    only = df.select("doc_id")
    assert simhash.keep_one(only.withColumn("text", F.lit("t")).select("doc_id", "text")).count() == 2
