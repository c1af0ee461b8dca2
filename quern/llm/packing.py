"""Token packing: documents to token pieces, pieces to sequences by bounded-space online best fit."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import documents, lean, record_batches, write_shared

#: Tokens in a sequence, the id that ends each document, and bins open at a time in a task.
CAPACITY, END_ID, OPEN_BINS = 2048, 0, 4096
#: Tokens that one task packs, about (8192 sequences): the few part-filled bins that it ends with hardly count.
TOKENS_A_TASK = 1 << 24
#: Characters of a text that are split into chunks at a time.
SLICE = 1 << 20
#: Chunks and words whose ids a worker keeps in each of two generations.
KEPT = 200_000
#: Little-endian unsigned 32-bit numbers, by their count.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]

_tokenizers: dict[str, ChunkTokenizer] = {}


class Kept(dict):
    """``make(key)`` for each key, remembered: a full generation becomes the old one, and what
    is asked for again moves to the new one.  Memory is bounded; frequent keys stay."""

    def __init__(self, make: Callable[[str], bytes], most: int = KEPT):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class ChunkTokenizer:
    """Ids of whole texts through the ids of their chunks between blanks and line feeds.

    For a tokenizer that drops white space and never joins across it, a text's ids are its
    chunks' ids in order, and most chunks recur.  A new chunk of printable Latin-1 characters
    (on which lower-casing and composition have no context) is split as the tokenizer splits
    it, and its new words go to the tokenizer's model; any other new chunk goes to the whole
    tokenizer.
    """

    #: The tokenizer file's own split pattern (a fixed value of word_bpe_49k.json).
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = r"[\x21-\x7e\xa1-\xff]*"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.base = Tokenizer.from_file(path)
        self.model = self.base.model
        self.split, self.plain = regex.compile(self.SPLIT).findall, regex.compile(self.PLAIN).fullmatch
        units = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.units = {c: "".join(x for x, _ in units.pre_tokenize_str(chr(c))) for c in range(0x80, 0x100)}
        self.chunks = Kept(self._chunk)

    def _word(self, word: str) -> bytes:
        found = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.units))]
        return _PACK[len(found)](*found) if len(found) < 64 else struct.pack(f"<{len(found)}I", *found)

    def _whole(self, text: str) -> bytes:
        return np.array(self.base.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk.isalpha() and chunk.islower():
                return self._word(chunk)
            plain = chunk.isprintable() and "<|" not in chunk
        else:
            plain = self.plain(chunk) and "<|" not in chunk
        if not plain:
            return self._whole(chunk)
        # Words are chunks, too; one that can't be split is the model's.
        low = chunk.lower()
        parts = self.split(low)
        return self._word(low) if parts == [chunk] else b"".join(map(self.chunks.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        text, parts, at = text.replace("\n", " "), [], 0
        while at < len(text):
            blank = text.find(" ", at + SLICE)
            end = len(text) if blank < 0 else blank
            parts.append(b"".join(map(self.chunks.__getitem__, text[at:end].split(" "))))
            at = end
        return b"".join(parts)


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "word_bpe_49k.json", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` and, ``with_ids``, ``ids`` (array of int).

    A document's ids are those of its text followed by id 0 (null or empty: that id alone).
    Only longer ones are cut, into pieces of ``capacity`` and a rest.  Every row is a
    document; rows that repeat an id repeat its pieces.
    """
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    out = T.StructType([*fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    schema = to_arrow_schema(out)
    end = int(END_ID).to_bytes(4, "little")

    def rows(batches):
        tokenizer = _tokenizer(tokenizer_path(name))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for i, text in zip(*(c.slice(at, 256).to_pylist() for c in b.columns)):
                    ids = tokenizer.encode(text) + end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        row = (i, piece, start // 4, len(cut) // 4, zlib.crc32(cut))
                        yield (*row, np.frombuffer(cut, "<i4")) if with_ids else row

    return df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(lean(lambda batches: record_batches(rows(batches), schema, most=2048 if with_ids else 16384)), out)


class OpenBins:
    """At most ``most`` open bins, found by a bitset with a bit for each amount of free space.

    ``place(length)`` puts a piece where the least space stays free, opening a bin if none has
    room; of more than ``most`` open bins the fullest closes first.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset)."""
        if length is None or not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} doesn't fit {self.capacity}")
        roomy = self.bits >> length
        if roomy:
            free = length + (roomy & -roomy).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return found, self.capacity - free


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tasks: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (clashing columns are replaced).

    ``tasks`` tasks (by default as many as the sum of all lengths asks for, ``TOKENS_A_TASK`` each)
    pack a share of the pieces each: best fit over at most ``open_bins`` open bins, in the order
    of all columns that aren't nested.  A task that is run again after an executor is lost
    therefore makes the same layout.  Sequence ids are the task's number times 2^40 plus the
    bin's.  A task holds its open bins and one Arrow batch.  Lengths must be 1 to ``capacity``: a
    null or any other length ends the job with a ValueError.  Repeated rows are packed each;
    an empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    if tasks is None:
        tasks = max(1, min(100_000, -(-(pieces.agg(F.sum(length_col)).first()[0] or 0) // TOKENS_A_TASK)))
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    schema = to_arrow_schema(out)

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        for b in batches:
            placed = [bins.place(n) for n in b.column(b.schema.get_field_index(length_col)).to_pylist()]
            ids, offsets = (np.array(x, np.int64) for x in (zip(*placed) if placed else ((), ())))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, schema)), pa.array(ids + first), pa.array(offsets)], schema=schema)

    order = [F.col(f"`{f.name}`") for f in pieces.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    return pieces.repartition(tasks).sortWithinPartitions(*order).mapInArrow(lean(run), out)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "word_bpe_49k.json", capacity: int = CAPACITY, with_ids: bool = False, tasks: int | None = None) -> DataFrame:
    """``token_pieces`` of every row of ``df``, packed.  Pieces are written once, so texts are tokenized once."""
    pieces, _ = write_shared(token_pieces(df, id_col, text_col, name, capacity, with_ids), "pieces")
    return pack(pieces, capacity=capacity, tasks=tasks)


def op5_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
