"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles.

Distinct fingerprints are dealt into tiles in the order of their population counts.  Two
fingerprints whose population counts differ by more than the radius cannot be within it,
so tile pairs whose counts lie further apart are skipped; every other pair is compared
whole, with exclusive-or and bit counts in numpy, and gives at most a spanning forest of
its links.  ``near_duplicates`` links by the fingerprints alone; ``similar_documents`` holds the
links of wider fingerprints against the Jaccard similarity of the shingles themselves, and finds
those that the fingerprints leave out by the rarest shingles of each text, without exception.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import documents, drop_shared, lean, record_batches, release, utf8, write_shared
from .components import component_labels
from .tokens import mix

#: Words in a shingle, differing bits that still link, and the hash's seed.
SHINGLE, RADIUS, SEED = 4, 4, 42
#: ``similar_documents``: words in a shingle, least Jaccard similarity, and the differing bits of 128 up to
#: which it is computed.  At similarity 0.8 some 20 bits differ, with a standard deviation of 4.
SIMILAR_SHINGLE, SIMILARITY, SIMILAR_RADIUS = 5, 0.8, 32
#: Spanning forests without a common link whose links ``similar_documents`` computes the similarity of.
FORESTS = 4
#: The sample by which ``similar_documents`` tells rare shingles from frequent ones: documents, shingles of one, times seen,
#: and frequent ones kept.  It only orders the shingles, so no link hangs on it.
SAMPLED, SAMPLED_SHINGLES, OFTEN, FREQUENT = 5000, 1024, 3, 100_000
#: Bits of a sketch, at least and at most; about two for each shingle in between.
LEAST_SKETCH, MOST_SKETCH = 1 << 8, 1 << 16
#: Rare shingles that a task compares, about; texts of one shingle that are held together; rows and pairs of a task and of a step.
POSTINGS, TOGETHER, MET_ROWS, STEP_PAIRS = 500_000, 4096, 100_000, 1 << 16
#: Bytes of sets that a task writes, about.
SETS_A_FILE = 16 << 20
#: Fingerprints of a tile at least and at most; in between, tables have about so many tiles.
LEAST_TILE, MOST_TILE, TILES = 1 << 14, 1 << 18, 64
#: Comparisons a task is to make, about (a second or so); links a comparison holds before it thins them out.
TASK_PAIRS, HELD_LINKS = 500_000_000, 1 << 20
#: Links that one task thins out, about.
THINNED_LINKS = 500_000
#: Rows of a few numbers that a task writes, about.
ROWS_A_FILE = 500_000
#: Bytes of a text whose words are split at a time.
SLICE = 1 << 20
_GAP = re.compile(rb"[\t-\r ]")


def shingle_hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, repeats included, some at a time.

    Shingles are ``shingle`` words with A-Z lower-cased, joined by blanks; with fewer words
    there is one shingle of all words, with none there is none.
    """
    text, held, at, some = text or b"", [], 0, False
    digest = xxhash.xxh64_digest
    while at < len(text):
        gap = _GAP.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = gap.end() if gap else len(text)
        held += text[at:end].lower().split()
        at = end
        if len(held) >= shingle:
            ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            view, count = memoryview(b" ".join(held)), len(held) - shingle + 1
            yield np.frombuffer(b"".join([digest(view[i:j], SEED) for i, j in zip(begins[:count].tolist(), ends[shingle - 1 :].tolist())]), ">u8")
            held, some = held[count:], True
    if held and not some:
        yield np.frombuffer(digest(b" ".join(held), SEED), ">u8")


def majority(hashes: Iterable[np.ndarray]) -> int:
    """A bit is 1 if set in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes:
        n += len(h)
        for i in range(0, len(h), 1 << 16):
            part = h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the XXH64 of the shingles (repeats included)."""
    return majority(shingle_hashes(text, shingle))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *(h.astype(np.uint64) for h in shingle_hashes(text, shingle))]))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id_col, fp)``; ``fp`` is the fingerprint as a signed long."""
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    schema = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.field(0).type), pa.array(fps)], schema=schema)

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), out)


def spanning_forest(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links ``(i, j)`` of lengths ``d`` a minimum spanning forest keeps, and each node's group.

    Boruvka's rounds: every group takes its shortest link (ties by the ends), all at once.
    """
    order = np.lexsort((j, i, d))
    i, j = i[order], j[order]
    group, chosen, live = np.arange(n), [], np.arange(len(order))
    while True:
        a, b = group[i[live]], group[j[live]]
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        if not len(live):
            break
        best = np.full(n, len(order))
        best[a[::-1]] = live[::-1]  # of repeated places the last one counts: the shortest
        other = np.full(n, len(order))
        other[b[::-1]] = live[::-1]
        best = np.minimum(best, other)
        asking = np.flatnonzero(best < len(order))
        link = best[asking]
        chosen.append(np.unique(link))
        parent = np.arange(n)
        parent[asking] = group[i[link]] + group[j[link]] - asking
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        group = parent[group]
    return order[np.concatenate(chosen)] if chosen else np.empty(0, np.int64), group


def spanning_forests(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int, forests: int) -> list[np.ndarray]:
    """The links of a minimum spanning forest, of one of the links that this leaves, and so on.

    Together they hold as much of any larger set of links as its forests could use.
    """
    found, rest = [], np.arange(len(d))
    for _ in range(forests):
        keep, _ = spanning_forest(i[rest], j[rest], d[rest], n)
        found.append(rest[keep])
        rest = np.delete(rest, keep)
    return found


def compare_tiles(a: np.ndarray, b: np.ndarray | None, radius: int, forests: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, distance)``: a minimum spanning forest of all pairs within ``radius``, or several (``spanning_forests``).

    ``a`` and ``b`` hold a fingerprint a row, in words of 64 bits; positions in ``b`` begin at
    ``len(a)``; without ``b`` the pairs are those within ``a``.  Links held are thinned out in
    between, and what a pair's shorter links connect already is not held at all.
    """
    same = b is None
    b = a if same else b
    shift, n = (0 if same else len(a)), len(a) + (0 if same else len(b))
    kept = (np.empty(0, np.int64),) * 3
    held, size, linked = [kept], 0, []
    levels = sorted({radius * k // 4 for k in range(5)})

    def thin():
        nonlocal held, size, linked
        i, j, d = (np.concatenate(x) for x in zip(*held))
        found = spanning_forests(i, j, d, n, forests)
        last = [x[found[-1]] for x in (i, j, d)]  # what this one connects, the ones before connect too
        linked = [(level, spanning_forest(*[x[last[2] <= level] for x in last], n)[1]) for level in levels]
        keep = np.concatenate(found)
        held, size = [(i[keep], j[keep], d[keep])], 0

    step = max(1, (1 << 19) // max(1, len(b)))
    for at in range(0, len(a), step):
        low, rows = (at + 1 if same else 0), a[at : at + step]  # of equal tiles, each pair once
        away = np.bitwise_count(rows[:, None, 0] ^ b[None, low:, 0])
        for w in range(1, a.shape[1]):
            away = away + np.bitwise_count(rows[:, None, w] ^ b[None, low:, w])
        near = away <= radius
        if same:
            near &= np.arange(low, len(b))[None, :] > np.arange(at, at + len(rows))[:, None]
        if not near.any():
            continue
        x, y = np.nonzero(near)
        d, x, y = away[x, y].astype(np.int64), x + at, y + low + shift
        for level, group in linked:
            new = (d < level) | (group[x] != group[y])
            x, y, d = x[new], y[new], d[new]
        held.append((x, y, d))
        size += len(x)
        if size > HELD_LINKS:
            thin()
    thin()
    return held[0]


def _matrix(row: dict, columns: tuple[str, ...]) -> np.ndarray:
    return np.stack([row[c].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in columns], axis=1)


def links_within(distinct: DataFrame, radius: int = RADIUS, columns: tuple[str, ...] = ("fp",), tile_rows: int | None = None, forests: int = 1) -> DataFrame:
    """``(a, b, distance)``: representatives whose links connect all that lie within ``radius`` of each other.

    ``distinct`` has ``rep`` and the fingerprint's words (at most three) in ``columns``, each
    fingerprint once or more.  Of each pair of tiles a minimum spanning forest (or several) is linked, so all
    together hold such forests of all pairs.  A tile goes to each tile it is
    compared with; a task holds one pair of tiles at a time.  Written to the shared folder.
    """
    spark = distinct.sparkSession
    pop = sum((F.bit_count(c) for c in columns[1:]), F.bit_count(columns[0])).cast("int")
    counts = sorted((r["pop"], r["n"]) for r in distinct.groupBy(pop.alias("pop")).agg(F.count("*").alias("n")).collect())  # at most 64 rows a word, and one
    total = sum(n for _, n in counts)
    rows = tile_rows or max(LEAST_TILE, min(MOST_TILE, -(-total // TILES)))
    # Places in the order of population counts; within one, by hash.
    ends = np.cumsum([n for _, n in counts])
    begin = {p: int(e) - n for (p, n), e in zip(counts, ends)}
    pops = np.array([p for p, _ in counts])
    spans = []
    for t in range(-(-total // rows)):
        least, most = (int(pops[np.searchsorted(ends, place, side="right")]) for place in (t * rows, min(total, (t + 1) * rows) - 1))
        first = begin[int(pops[np.searchsorted(pops, least - radius)])] // rows
        last = (int(ends[np.searchsorted(pops, most + radius, side="right") - 1]) - 1) // rows
        spans.append((t, first, last))
    out = T.StructType([T.StructField("a", distinct.schema["rep"].dataType), T.StructField("b", distinct.schema["rep"].dataType), T.StructField("distance", T.IntegerType())])
    if not spans:
        return spark.createDataFrame([], out)
    schema = to_arrow_schema(out)
    of = lambda table: F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in table.items() for x in kv]), pop.cast("long"))
    place = of(begin) + F.floor(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) * of(dict(counts)) / (1 << 30))
    # Rows of a tile in an order of their own: which of equally short links a forest takes hangs on it.
    tiles = distinct.select(F.floor(place / rows).cast("int").alias("tile"), *columns, "rep").groupBy("tile").agg(F.sort_array(F.collect_list(F.struct(*columns, "rep"))).alias("row"))
    tiles, path = write_shared(tiles.select("tile", *[F.col("row")[c].alias(c) for c in (*columns, "rep")]), "tiles")
    # A row of three numbers for each tile.
    met = tiles.join(F.broadcast(spark.createDataFrame(spans, "tile int, first int, last int")), "tile")
    met = met.select("tile", *columns, "rep", F.explode(F.sequence("first", "last")).alias("other")).withColumns({"t": F.least("tile", "other"), "u": F.greatest("tile", "other")})

    def run(table: pa.Table) -> pa.Table:
        found = sorted(({c: table.column(c)[k] for c in table.column_names} for k in range(table.num_rows)), key=lambda r: r["tile"].as_py())
        sides = [_matrix(r, columns) for r in found]
        i, j, d = compare_tiles(sides[0], sides[1] if len(sides) > 1 else None, radius, forests)
        reps = pa.concat_arrays([r["rep"].values for r in found]).cast(schema.field(0).type)
        return pa.table([reps.take(pa.array(i)), reps.take(pa.array(j)), pa.array(d, pa.int32())], schema=schema)

    # As many tasks as the comparisons ask for; sizes in bytes say little about them.
    pairs = sum(last - t + 1 for t, _, last in spans)
    tasks = max(1, min(100_000, pairs, -(-pairs * rows * min(rows, total) // TASK_PAIRS)))
    links, _ = write_shared(met.drop("other").repartition(tasks, "t", "u").groupBy("t", "u").applyInArrow(run, out), "links")
    drop_shared(spark, path)
    return links


def _in_few_files(narrow: DataFrame, source: DataFrame | int) -> DataFrame:
    """``narrow``, no longer than the written ``source`` (or so many rows), in tasks of ``ROWS_A_FILE`` rows, not one for each shuffle partition."""
    return narrow.coalesce(max(1, -(-(source if isinstance(source, int) else source.count()) // ROWS_A_FILE)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row: 16 hex digits, and the smallest id reachable by links.

    Texts link if their fingerprints differ in ``radius`` bits or fewer.  Null, empty and
    blank texts have fingerprint 0 and link like any other; very long texts are hashed a
    slice at a time.  Rows that repeat an id each
    have their row; all copies of one text share a fingerprint, of which the comparison sees
    one.  A null id is never a representative: a component of null ids only has a null
    ``component_id``.  An empty table gives an empty one; other columns are not read.
    """
    fps, _ = write_shared(fingerprints(df, id_col, text_col, shingle).withColumnRenamed(id_col, "id"), "fingerprints")
    distinct, _ = write_shared(_in_few_files(fps.groupBy("fp").agg(F.min("id").alias("rep")), fps), "distinct")
    named = component_labels(links_within(distinct.where("rep IS NOT NULL"), radius))
    # By fingerprint: each is once on the right, so copies are not multiplied and AQE splits a hot one.
    classes = distinct.join(named, distinct["rep"] == named["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that a sample of ``docs(id, text)`` holds ``OFTEN``, sorted, and how often each is there."""
    every = max(1, -(-docs.count() // SAMPLED))
    found, counted = T.StructType([T.StructField("hashes", T.BinaryType())]), T.StructType([T.StructField("hash", T.LongType()), T.StructField("n", T.LongType())])

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shingle_set(t, shingle)[:SAMPLED_SHINGLES].tobytes() for t in utf8(b.column(0))], pa.binary())], ["hashes"])

    def count(batches):
        hashes, n = np.unique(np.frombuffer(b"".join(x for b in batches for x in b.column(0).to_pylist()), np.uint64), return_counts=True)
        often = np.flatnonzero(n >= OFTEN)
        often = often[np.argsort(-n[often], kind="stable")[:FREQUENT]]
        yield pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["hash", "n"])

    sample = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0).select("text").mapInArrow(lean(sets), found)
    table = sample.repartition(1).mapInArrow(lean(count), counted).toArrow()  # some thousand rows of two numbers
    hashes, n = table.column("hash").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def rarest(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of the sorted hashes ``found`` in the order of frequency, so many that any similar set has one of them among its own.

    A set of n hashes shares at least ``similarity`` * n with a similar one; the first hash they share, in an order
    common to all sets, has so many behind it, itself included.
    """
    hashes, n = frequent
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        found = found[np.argsort(np.where(hashes[at] == found, n[at], 0), kind="stable")]
    return found[: len(found) - math.ceil(similarity * len(found) - 1e-6) + 1]


def sketch(found: np.ndarray) -> bytes:
    """Whether an odd number of the hashes falls on each of a power of two of places: sets differ by at least as many hashes as places."""
    bits = max(LEAST_SKETCH, min(MOST_SKETCH, 1 << (2 * len(found)).bit_length()))
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _described(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(id, fp0, fp1, node, n, handle, rare, sketch)`` of ``docs(id, text)``: 128 bits over the distinct shingles, a digest of
    their set, its size, 40 bits of the digest, the ``rarest`` hashes and a ``sketch``."""
    out = T.StructType([docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("fp0", "fp1")), T.StructField("node", T.BinaryType())])
    out = T.StructType([*out.fields, *(T.StructField(c, T.LongType()) for c in ("n", "handle")), *(T.StructField(c, T.BinaryType()) for c in ("rare", "sketch"))])
    schema, frequent = to_arrow_schema(out), docs.sparkSession.sparkContext.broadcast(_frequent(docs, shingle))

    def rows(batches):
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                found = shingle_set(text, shingle)
                node = _digest(found)
                fps = np.array([majority([found]), majority([mix(found)])], np.uint64).view(np.int64).tolist()
                yield i, *fps, node, len(found), int.from_bytes(node[:5], "big"), rarest(found, frequent.value, similarity).tobytes(), sketch(found)

    return docs.select("id", "text").mapInArrow(lean(lambda batches: record_batches(rows(batches), schema, weight=lambda r: len(r[6]) + len(r[7]), most_weight=8 << 20)), out)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _thinned(links: DataFrame, forests: int = 1) -> DataFrame:
    """A part of ``links(a, b, distance)`` that holds a minimum spanning forest of them, or several; written.

    Each task keeps forests of its share, some hundred thousand links.  Shares are dealt by the links'
    ends, and of equally short links those of the least ends are taken, so reruns keep the same ones.
    """
    out, tasks = links.schema, max(1, -(-links.count() // THINNED_LINKS))
    schema = to_arrow_schema(out)

    def run(batches):
        whole = pa.Table.from_batches(list(batches), schema=schema)
        ends = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole.columns[:2]]).dictionary_encode()
        place = np.empty(len(ends.dictionary), np.int64)
        place[pc.array_sort_indices(ends.dictionary).to_numpy()] = np.arange(len(place))
        at = place[ends.indices.to_numpy(zero_copy_only=False)]
        keep = np.concatenate(spanning_forests(at[: len(whole)], at[len(whole) :], whole.column(2).to_numpy(), len(ends.dictionary), forests))
        yield from whole.take(pa.array(np.sort(keep))).combine_chunks().to_batches(max_chunksize=10_000)

    return write_shared(links.repartition(tasks, "a", "b").mapInArrow(lean(run), out), "thinned")[0]


def _verified(links: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``(a, b)`` of ``links`` whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    kept = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("hashes", T.BinaryType())])
    schema = to_arrow_schema(kept)

    def sets(batches):
        def rows():
            for b in batches:
                for node, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                    found = shingle_set(text, shingle)
                    if _digest(found) == node:  # a row that only repeats the id is another text
                        yield node, found.tobytes()

        yield from record_batches(rows(), schema, weight=lambda r: len(r[1]), most_weight=8 << 20)

    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = nodes.join(ends, "node", "left_semi").select("node", F.col("rep").alias("id"))
    texts = docs.join(asked, "id").select("node", "text")
    size = 8 * (nodes.join(ends, "node", "left_semi").agg(F.sum("n")).first()[0] or 0)
    held, _ = write_shared(texts.mapInArrow(lean(sets), kept).groupBy("node").agg(F.min("hashes").alias("hashes")).coalesce(max(1, -(-size // SETS_A_FILE))), "sets")
    pairs = links.join(held.select(F.col("node").alias("a"), F.col("hashes").alias("mine")), "a").join(held.select(F.col("node").alias("b"), F.col("hashes").alias("other")), "b")
    out = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    pair = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                mine, other = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                good.append(both >= similarity * (len(mine) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=pair).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "mine", "other").mapInArrow(lean(run), out)


def _postings(rows: DataFrame) -> DataFrame:
    """``(hash, handle, place)`` of the ``rare`` hashes of ``rows`` that two sets or more have, each set once; ``place`` is that in the set's order.

    Hashes are dealt by their size, so tasks have equal shares; copies of a set are dropped where they lie together, and at last where they meet.
    """
    total = rows.agg(F.sum(F.octet_length("rare"))).first()[0] or 0
    buckets = max(1, -(-total // 8 // POSTINGS))
    dealt = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("where", T.BinaryType())])
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("hash", "handle", "place")])
    dealt_schema, schema = to_arrow_schema(dealt), to_arrow_schema(out)

    def deal(held: dict[bytes, tuple[int, bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(rare) // 8 for _, rare in held.values()], np.int64)
        hashes = np.frombuffer(b"".join(rare for _, rare in held.values()), np.uint64)
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        where = np.repeat(np.array([h for h, _ in held.values()], np.uint64), sizes) << np.uint64(24) | np.minimum(place, (1 << 24) - 1).astype(np.uint64)
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, begin = np.unique(bucket[order], return_index=True)
        parts = [order[i:j] for i, j in zip(begin, [*begin[1:], len(order)])]
        return pa.RecordBatch.from_arrays([pa.array(found), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (hashes, where))], schema=dealt_schema)

    def spread(batches):
        held, size = {}, 0
        for b in batches:
            for node, handle, rare in zip(*(c.to_pylist() for c in b.columns)):
                if rare and node not in held:
                    held[node] = handle, rare
                    size += len(rare)
                if size >= 8 * POSTINGS:
                    yield deal(held)
                    held, size = {}, 0
        if held:
            yield deal(held)

    def meet(table: pa.Table) -> pa.Table:
        hashes, where = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("hashes", "where"))
        order = np.lexsort((where, hashes))
        hashes, where = hashes[order], where[order]
        again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (where[1:] == where[:-1])) + 1
        hashes, where = np.delete(hashes, again), np.delete(where, again)
        same = hashes[1:] == hashes[:-1]
        keep = np.append(False, same) | np.append(same, False)
        hashes, where = hashes[keep], where[keep]
        found = pa.table([pa.array(x.view(np.int64)) for x in (hashes, where >> np.uint64(24), where & np.uint64((1 << 24) - 1))], schema=schema)
        del hashes, where, order, again, same, keep
        release()
        return found

    return write_shared(rows.select("node", "handle", "rare").mapInArrow(lean(spread), dealt).groupBy("bucket").applyInArrow(meet, out).coalesce(buckets), "postings")[0]


class Sketches:
    """Sketches of many sets, compared many pairs at once."""

    def __init__(self, sketches: list[bytes]):
        self.size, self.at, self.rows = np.array([len(x) // 8 for x in sketches], np.int64), np.empty(len(sketches), np.int64), {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == size)
            self.at[rows] = np.arange(len(rows))
            self.rows[size] = np.frombuffer(b"".join([sketches[k] for k in rows]), np.uint64).reshape(len(rows), size)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places in which the sketches of each pair differ, the larger folded to the size of the smaller."""
        found = np.empty(len(i), np.int64)
        for a, b in np.unique(np.stack([self.size[i], self.size[j]], axis=1), axis=0).tolist():
            here = np.flatnonzero((self.size[i] == a) & (self.size[j] == b))
            step = max(1, (1 << 20) // max(a, b))
            for at in (here[k : k + step] for k in range(0, len(here), step)):
                x, y = self.rows[a][self.at[i[at]]], self.rows[b][self.at[j[at]]]
                while x.shape[1] != y.shape[1]:
                    half = max(x.shape[1], y.shape[1]) // 2
                    x, y = (v[:, :half] ^ v[:, half:] if v.shape[1] > half else v for v in (x, y))
                found[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return found


def possible_pairs(group: np.ndarray, part: np.ndarray, whole: np.ndarray, n: np.ndarray, place: np.ndarray, component: np.ndarray, sketches: Sketches, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(i, j)`` of one group and of unlike components whose sets may be similar.

    Rows come by group and, in it, by size.  Pairs go whose sizes, places of the common hash or sketches prove that
    they are not similar.  In groups that are not ``whole``, pairs are those of unlike parts.
    """
    found, held, size = [(np.empty(0, np.int64),) * 2], [], 0

    def sift():
        nonlocal held, size
        i, j = (np.concatenate(x) for x in zip(*held))
        good = sketches.apart(i, j) <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + 1e-6
        found.append((i[good], j[good]))
        held, size = [], 0

    i, step = np.arange(len(group)), 0
    while len(i):
        step += 1
        i = i[: np.searchsorted(i, len(group) - step)]
        j = i + step
        near = (group[i] == group[j]) & (n[i] >= similarity * n[j] - 1e-6)  # false for all larger steps, too
        i, j = i[near], j[near]
        least = similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6
        good = (component[i] != component[j]) & (whole[i] | (part[i] != part[j])) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= least)
        if good.any():
            held.append((i[good], j[good]))
            size += len(held[-1][0])
            if size >= STEP_PAIRS:
                sift()
    if held:
        sift()
    return tuple(np.concatenate(x) for x in zip(*found))


def _missed(rows: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: all nodes of unlike components whose sets may be similar; written.

    Similar sets share one of their ``rarest`` hashes.  Of each hash, what lies in more than one component is compared, pair by pair;
    a hash of many sets is dealt into parts, of which each two are compared in a task.
    """
    postings = _postings(rows)
    held, path = write_shared(_in_few_files(postings.join(classes.select("node", "handle", "n", F.xxhash64("component").alias("component")), "handle"), postings), "held")
    shared = held.groupBy("hash").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows")).where("low <> high")
    shared, shared_path = write_shared(_in_few_files(shared.select("hash", "rows", F.ceil(F.col("rows") / TOGETHER).alias("parts")), held), "shared")
    met = held.join(shared.select("hash", "parts"), "hash").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumns({"t": F.least("part", "other"), "u": F.greatest("part", "other")})
    met_rows = shared.agg(F.sum(F.col("rows") * F.col("parts"))).first()[0] or 0
    met, met_path = write_shared(_in_few_files(met.drop("other", "parts", "handle"), met_rows), "met")
    # Copies of a set are combined where they lie, before any are moved (Spark would push a semi-join below the aggregate).
    sketches = rows.groupBy("node").agg(F.min("sketch").alias("sketch")).join(met.select("node").distinct(), "node")
    out = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    schema, key = to_arrow_schema(out), ["hash", "t", "u"]

    def pairs(table: pa.Table) -> pa.RecordBatch:
        hashes, t, u, part, n, place, component = (table.column(c).to_numpy() for c in (*key, "part", "n", "place", "component"))
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (t[1:] != t[:-1]) | (u[1:] != u[:-1]))
        i, j = possible_pairs(np.cumsum(new), part, t == u, n, place, component, Sketches(table.column("sketch").to_pylist()), similarity)
        nodes = table.column("node").combine_chunks().dictionary_encode()
        at = nodes.indices.to_numpy()
        ends = np.unique(np.sort(np.stack([at[i], at[j]], axis=1), axis=1), axis=0)
        # Which end is named first is settled by the nodes, so that all tasks name a pair alike.
        ends = [sorted(nodes.dictionary[int(k)].as_py() for k in pair) for pair in ends]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], schema=schema)

    def run(batches):
        held, last = [], None
        for b in batches:
            # Up to where the last group begins, all groups are whole.
            at = [b.column(c).to_numpy() for c in key]
            ends = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in at])) + 1
            first, cut = tuple(int(x[0]) for x in at) != last, int(ends[-1]) if len(ends) else 0
            if held and (first or cut):
                yield pairs(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield pairs(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
            last = tuple(int(x[-1]) for x in at)
        if held:
            yield pairs(pa.Table.from_batches(held))

    tasks = max(1, -(-met_rows // MET_ROWS))
    dealt = met.join(sketches, "node").repartition(tasks, *key).sortWithinPartitions(*key, "n")
    found, _ = write_shared(_in_few_files(dealt.mapInArrow(lean(run), out).distinct(), met_rows), "missed")
    for p in (path, shared_path, met_path):
        drop_shared(rows.sparkSession, p)
    return found


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, radius: int = SIMILAR_RADIUS) -> DataFrame:
    """``(id_col, component_id)`` for every row: the smallest id reachable by links of similar texts.

    Two texts are similar if the Jaccard similarity of their sets of ``shingle`` words (fewer words: the
    whole sequence) is ``similarity`` (above 0) or more.  All pairs of distinct sets are compared by
    128-bit fingerprints in tiles; ``FORESTS`` minimum spanning forests of those within ``radius`` bits, which
    share no link, are then held against the sets themselves.  What this leaves in unlike components is
    searched by the sets' rarest shingles, of which similar sets must share one, and held against the sets
    as well: no link is false, and none is lost.

    Null, empty and blank texts have the empty set and are copies of each other; texts of one set,
    whatever their order, are too.  Rows that repeat an id each have their row.  A
    component of null ids only has a null ``component_id``.  An empty table gives an empty
    one; other columns are not read.  A text's set, 8 bytes a word, is held as a whole.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, _ = write_shared(_described(docs, shingle, similarity), "described")
    least = [F.min(c).alias(c) for c in ("fp0", "fp1", "n", "handle")]
    nodes, _ = write_shared(_in_few_files(rows.groupBy("node").agg(F.min("id").alias("rep"), *least), rows), "nodes")
    links = _thinned(links_within(nodes.where("rep IS NOT NULL").select("fp0", "fp1", F.col("node").alias("rep")), radius, ("fp0", "fp1"), forests=FORESTS), FORESTS)
    named = component_labels(_verified(links, nodes, docs, shingle, similarity))
    classes, _ = write_shared(_in_few_files(nodes.join(named, "node", "left").select("node", "rep", "n", "handle", F.coalesce("component", "node").alias("component")), nodes), "classes")
    pairs = _missed(rows, classes.where("rep IS NOT NULL"), similarity)
    missed = _verified(pairs, nodes, docs, shingle, similarity)
    of = classes.select("node", "component")
    joined = missed.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    wider = component_labels(_in_few_files(joined, pairs)).toDF("component", "wider")
    classes = classes.join(wider, "component", "left").select("node", "rep", F.coalesce("wider", "component").alias("component"))
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows.join(classes.join(least, "component").select("node", "component_id"), "node").select(F.col("id").alias(id_col), "component_id")


def _holds_map(kind: T.DataType) -> bool:
    parts = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, T.MapType) or any(map(_holds_map, parts))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates) -> DataFrame:
    """The rows of ``df``, with all columns, of each component's smallest id; components are those of ``find``.

    Rows that repeat that id are one document: the one of the least hash over all columns but
    maps stays.  Rows without an id cannot be referred to; they take no part and all stay.  Texts move once, by id.
    Columns may have any name.
    """
    named, names = df.where(F.col(id_col).isNotNull()), [f"c{i}" for i in range(len(df.columns))]
    kept = find(named, id_col, text_col).select(F.col("component_id").alias("kept_id")).distinct()
    at = names[df.columns.index(id_col)]
    others = [c for c in names if c != at]
    stay = named.toDF(*names).join(kept, F.col(at) == F.col("kept_id"), "left_semi")
    if others:
        hashed = [F.col(c) for c, f in zip(names, df.schema.fields) if not _holds_map(f.dataType)]
        order = F.struct(F.xxhash64(*hashed), F.xxhash64(F.lit(1), *hashed))
        # Partitioned by id already: no further shuffle.
        stay = stay.groupBy(at).agg(F.min_by(F.struct(*others), order).alias("row")).select(*[F.col(c) if c == at else F.col("row")[c].alias(c) for c in names])
    else:
        stay = stay.distinct()
    return stay.toDF(*df.columns).unionByName(df.where(F.col(id_col).isNull()))


def op6_simhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
