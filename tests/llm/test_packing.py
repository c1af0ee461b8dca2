import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return packing.ChunkTokenizer(packing.tokenizer_path())


def plain(tokenizer, text):
    return np.array(tokenizer.base.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


TEXT = st.text(st.one_of(st.sampled_from("aAbZ '\n\t .,!0129éÉßµ²\xa0\x85\xad\x1cΣς́İ<|>日😀"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_chunks_give_the_ids_of_the_whole(tokenizer, text):
    assert tokenizer.encode(text) == plain(tokenizer, text)


def test_special_words_and_full_caches(tokenizer, rows):
    small = packing.ChunkTokenizer(packing.tokenizer_path())
    small.chunks.most = 5
    for text in ["a<|endoftext|>b c", "<|startoftext|> hi", "<|no|>", "I'LL don't 'S", "x" * 3000, *(r[1] or "" for r in rows)]:
        assert small.encode(text) == plain(tokenizer, text) == tokenizer.encode(text)
    assert len(small.chunks) <= 5 and len(small.chunks.old) <= 5


def slow_best_fit(lengths, capacity, most):
    """The method word by word, over a plain list of (free, bins as they came)."""
    open_, made, out = [], 0, []
    for n in lengths:
        room = [b for b in open_ if b[0] >= n]
        if room:
            b = min(room, key=lambda b: (b[0], -b[2]))
        else:
            b = [capacity, made, 0]
            made += 1
            open_.append(b)
        out.append((b[1], capacity - b[0]))
        b[0] -= n
        b[2] = len(out)
        open_ = [x for x in open_ if x[0]]
        if len(open_) > most:
            open_.remove(min(open_, key=lambda x: (x[0], -x[2])))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 6))
def test_bins_follow_the_method(lengths, most):
    bins = packing.OpenBins(20, most)
    assert [bins.place(n) for n in lengths] == slow_best_fit(lengths, 20, most)
    assert bins.open <= most
    with pytest.raises(ValueError):
        bins.place(21)
    with pytest.raises(ValueError):
        bins.place(0)


def check(rows, got, capacity=2048):
    """Pieces are those of the tokenizer alone; sequences are gapless and within the capacity."""
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, p, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= capacity
    total = sum(r["length"] for r in got)
    return len(sequences), -(-total // capacity)


def test_documents(spark, docs, rows, table_dir):
    from quern.llm.queries import QUERIES

    made, least = check(rows, QUERIES["op5_packing"](spark, table_dir).collect())
    assert made <= least + 1
    made, least = check(rows, packing.pack_documents(docs, capacity=64).collect(), 64)
    assert made <= 1.05 * least


def test_ids_are_kept_if_asked_for(docs):
    for r in packing.token_pieces(docs, capacity=100).collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_edge_cases(empty, clashing, docs):
    assert packing.pack_documents(empty).count() == 0
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert key(packing.pack_documents(clashing)) == key(packing.pack_documents(docs))
    assert key(packing.pack_documents(docs.union(docs))) == sorted(2 * key(packing.pack_documents(docs)))
    clash = packing.token_pieces(docs, with_ids=False).selectExpr("*", "'x' AS sequence_id", "'y' AS offset")
    assert packing.pack(clash).columns.count("offset") == 1


def test_a_task_that_is_run_again_makes_the_same_layout(docs):
    """Whatever the order in which pieces arrive."""
    pieces = packing.token_pieces(docs, capacity=64, with_ids=False).cache()
    layout = lambda df: sorted((r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in df.collect())
    first = layout(packing.pack(pieces.coalesce(1), capacity=64, tasks=1))
    assert first == layout(packing.pack(pieces.repartition(5, "length").coalesce(1), capacity=64, tasks=1))
    assert len({r["sequence_id"] >> 40 for r in packing.pack(pieces, capacity=64, tasks=3).collect()}) == 3


def test_lengths_must_fit(spark):
    for length in (None, 0, 65):
        with pytest.raises(Exception, match="doesn't fit"):
            packing.pack(spark.createDataFrame([(1, length)], "doc_id long, length long"), capacity=64).collect()


def test_long_texts_are_split_in_slices(monkeypatch, rows):
    t = packing._tokenizer(packing.tokenizer_path())
    whole = [t.encode(r[1] or "") for r in rows]
    for size in (1, 10):
        monkeypatch.setattr(packing, "SLICE", size)
        assert [t.encode(r[1] or "") for r in rows] == whole
