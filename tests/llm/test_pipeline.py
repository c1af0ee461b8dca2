"""Each stage on its own input against a brute-force version of its decision."""

from collections import Counter, defaultdict

import corpus_pipeline
from quern.llm import quality

from .test_linededup import brute
from .test_mixing import WORD, targets
from .test_packing import check
from .test_simhash import brute_similar


def test_stages_in_turn(spark, docs, labels, table_dir):
    columns, seen = docs.columns, []
    df = docs
    for _, stage in corpus_pipeline.STAGES:
        df = spark.createDataFrame(seen[-1], docs.schema) if seen else docs
        out = stage(spark, df, table_dir)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == columns
        seen.append([tuple(r) for r in out.collect()] if out.columns == columns else out.collect())
    first, lines, near, mixed, packed = seen
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert sorted(map(repr, first)) == sorted(repr(tuple(r)) for r in docs.collect() if scores[r["doc_id"]] >= 0.7)
    assert sorted((r[0], r[1] or "") for r in lines) == sorted((i, t) for i, _, _, t in brute([r[:2] for r in first]))
    changed = {r[0]: r for r in first}
    assert all(r[4] == (changed[r[0]][4] if r[1] == changed[r[0]][1] else len(r[1])) and r[2:4] == changed[r[0]][2:4] for r in lines)
    keep = set(brute_similar(lines)[0].values())
    assert sorted(map(repr, near)) == sorted(repr(r) for r in lines if r[0] in keep)
    sizes = defaultdict(int)
    for r in near:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    taken = defaultdict(int)
    for r in mixed:
        taken[r[3]] += len(WORD.findall(r[1]))
    assert all(t - 1 - 1e-6 <= taken[s] <= t + 1e-6 for s, t in targets(sizes).items())
    assert max(Counter(r[0] for r in mixed).values()) <= 3
    made, least = check(mixed, packed)  # each of four tasks packs what it has
    assert made <= least + 4


def test_run_is_the_stages_in_turn(spark, table_dir):
    from quern.llm import _shared

    df = _shared.documents(spark, table_dir)
    for _, stage in corpus_pipeline.STAGES:
        df, _ = _shared.write_shared(stage(spark, df, table_dir), "stage")
    key = lambda d: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in d.collect())
    assert key(corpus_pipeline.run(spark, table_dir)) == key(df)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_empty_documents(spark, empty, table_dir):
    df = empty
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, table_dir)
    assert df.count() == 0
