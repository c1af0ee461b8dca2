"""Line deduplication: lines that many documents share stay in one document only.

Lines are exploded in the JVM and hashed; an aggregate by hash counts distinct
documents; the lines to drop go back to their documents as positions.  Only
hashes and positions are shuffled by line; whole texts move once, by document.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import ASCII_SPACE, ascii_lower, documents, lean, record_batches, utf8, write_shared

MIN_CHARS, MIN_DOCUMENTS = 20, 3
#: Lines that a task counts and writes the shared ones of, about.
LINES_A_TASK = 500_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _shared_lines(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_documents: int) -> DataFrame:
    """``(id, drops)``: the positions of the lines that documents lose."""
    lines = (
        df.where(F.octet_length(text_col) >= min_chars)
        .select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
        .select("id", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        # Two 64-bit hashes with unlike seeds stand for the key: 128 bits.
        .select("id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    # Narrow, and written once: lines are split and hashed once, for the count and for the join.
    lines, _ = write_shared(lines, "hashes")
    # Counts distinct documents by two aggregates, each with a map-side part, so a line that
    # a third of all documents hold reaches no task as more than one row a map task.
    pairs = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    shared = pairs.groupBy("h1", "h2").agg(F.count("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_documents).select("h1", "h2", "keeper")
    # Written, so that the join reads both sides through exchanges of its own: AQE then splits a
    # hot hash, or broadcasts a small list.  Each hash is once in ``shared``: at most one row a line.
    shared, _ = write_shared(shared.coalesce(max(1, -(-lines.count() // LINES_A_TASK))), "lines")
    drops = lines.join(shared, ["h1", "h2"]).where(F.col("id") != F.col("keeper"))
    return drops.groupBy("id").agg(F.collect_list("pos").alias("drops"))


def _rebuild(docs: DataFrame, out: T.StructType, make) -> DataFrame:
    """Applies ``make(row values, kept text or None, n_lines, n_dropped)`` to (columns..., text, drops)."""
    schema = to_arrow_schema(out)

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                *others, texts, drops = (c.slice(at, 512) for c in b.columns)
                rest = zip(*(c.to_pylist() for c in others)) if others else ((),) * len(texts)
                for values, text, gone in zip(rest, utf8(texts), drops.to_pylist()):
                    lines = (text or b"").split(b"\n")
                    if gone:
                        lost = set(gone)
                        kept = b"\n".join(x for i, x in enumerate(lines) if i not in lost)
                    else:
                        kept = text
                    yield make(values, kept, len(lines), len(set(gone)) if gone else 0)

    def run(batches):
        yield from record_batches(rows(batches), schema, most=1024, weight=lambda r: sum(len(x) for x in r if isinstance(x, (str, bytes))))

    return docs.mapInArrow(lean(run), out)


def _with_drops(df: DataFrame, columns: list[str], id_col: str, text_col: str, min_chars: int, min_documents: int) -> DataFrame:
    drops = _shared_lines(df, id_col, text_col, min_chars, min_documents)
    docs = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.join(drops, "id", "left").select(*[f"c{i}" for i in range(len(columns))], "text", "drops")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) with the text that stays, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased.
    Keys of ``min_chars`` code points or more in ``min_documents`` documents or more stay in
    the document of the largest id only (every copy of the line there); other lines are untouched.

    Null or empty text: one empty line, text unchanged.  Rows that repeat an id count as
    one document and lose the same lines by position only if their texts are equal; ids
    should be unique.  A null id never counts, and its rows lose no line.  A document whose
    every line goes has an empty text.  Columns that clash with ``n_lines`` or ``n_dropped`` are replaced.
    """
    columns = [c for c in (columns or df.columns) if c not in ("n_lines", "n_dropped")]
    out = T.StructType([*(T.StructField(c, T.StringType() if c == text_col else df.schema[c].dataType) for c in columns), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = columns.index(text_col) if text_col in columns else None

    def make(values, kept, n_lines, n_dropped):
        if at is not None and n_dropped:
            values = (*values[:at], kept.decode("utf-8", "replace"), *values[at + 1 :])
        return (*values, n_lines, n_dropped)

    return _rebuild(_with_drops(df, columns, id_col, text_col, min_chars, min_documents), out, make)


def keep_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """As ``dedup_lines``, with the columns of ``df`` and no others; ``n_chars``, where there is one, follows a text that loses lines."""
    names = [f"v{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names))
    lines = dedup_lines(df.toDF(*names), at[id_col], at[text_col], min_chars, min_documents)
    if "n_chars" in at:
        count = F.char_length(at[text_col]).cast(df.schema["n_chars"].dataType)
        lines = lines.withColumn(at["n_chars"], F.when(F.col("n_dropped") > 0, count).otherwise(F.col(at["n_chars"])))
    return lines.select(*names).toDF(*df.columns)


def line_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """As ``dedup_lines``, with the SHA-256 of the text that stays instead of columns."""
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def make(values, kept, n_lines, n_dropped):
        return (*values, n_lines, n_dropped, hashlib.sha256(kept or b"").hexdigest())

    return _rebuild(_with_drops(df, [id_col], id_col, text_col, min_chars, min_documents), out, make)


def op3_line_dedup(spark, sf_dir) -> DataFrame:
    return line_digests(documents(spark, sf_dir))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos, len(l) AS n_lines
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keys AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keys WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, k.n_lines, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keys k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, CAST(max(n_lines) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
