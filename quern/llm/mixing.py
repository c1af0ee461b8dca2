"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key.  Keys are cut into equal ranges within each
source, so that a source with a third of all rows is sorted in thousands of pieces;
prefix sums of sizes are those within a range plus the total of the ranges before it.
Each source takes whole epochs, then the prefix that fills its budget exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, documents, write_shared

#: Key ranges a source (a power of 16: the range is the key's first hex digits).
RANGE_DIGITS = 3
#: A document is taken at most so many times.
MAX_EPOCHS = 3
#: Sources up to which their cuts, a row of some 100 bytes each, are broadcast.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``totals(no_source, source, source_size)``, one row a source, with ``target`` (double).

    Sources in the order of their code points, null last, weigh 1, 2, 3, 1, 2, 3, ...
    The total of all sizes is shared by weight; targets stop at ``max_epochs`` times the
    source's size and the excess goes to the others by weight.  That is the one level at
    which the capped shares add up to the total: sources sorted by cap / weight, the level
    follows from prefix sums.  A row a source is all these windows see.
    """
    order = Window.orderBy("no_source", "source")
    every = Window.partitionBy()
    ranked = totals.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # With all earlier sources capped, this one and the later ones share the rest.
    levels = ranked.withColumn("level", (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # The first source that its share doesn't fill past the cap sets the level.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    return levels.withColumn("common", level.over(every)["level"]).select("no_source", "source", "source_size", F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))).alias("target"))


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` with ``no_source, source_key, size, key, cut`` of every row."""
    return df.select(
        *keep,
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
    ).withColumn("cut", F.substring("key", 1, RANGE_DIGITS))


def mixture_cuts(narrow: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For each source of ``narrow(no_source, source_key, size, key, cut)`` what its documents take.

    ``source_size, target``, the whole ``epochs``, and the ``edge`` key: documents of smaller
    keys are taken once more, those of the edge share ``edge_take`` of ``edge_size`` words, later
    ones are not.  Ranges are summed with a map-side part; only the one range of each
    source in which its budget ends is sorted.
    """
    source = ["no_source", "source_key"]
    ranges = narrow.groupBy(*source, "cut").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("no_source", F.col("source_key").alias("source")).agg(F.sum("range_size").alias("source_size")), max_epochs)
    budgets = (
        targets.withColumn("budget", F.floor("target").cast("long"))
        .withColumn("epochs", F.expr("budget div greatest(source_size, 1)").cast("long"))
        .select("no_source", F.col("source").alias("source_key"), "source_size", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest"))
    )
    budgets, _ = write_shared(budgets, "budgets")  # a row a source, used twice
    earlier = Window.partitionBy(*source).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).join(budgets, source).where("start <= rest AND rest < start + range_size").select(*source, "cut", "start", "rest")
    units = narrow.join(ends, [*source, "cut"]).groupBy(*source, "key").agg(F.sum("size").alias("edge_size"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    before = Window.partitionBy(*source).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    edge = units.withColumn("ahead", F.col("start") + F.coalesce(F.sum("edge_size").over(before), F.lit(0))).where("ahead <= rest AND rest < ahead + edge_size").select(*source, F.col("key").alias("edge"), "edge_size", (F.col("rest") - F.col("ahead")).alias("edge_take"))
    return budgets.drop("rest").join(edge, source, "left")


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with their source's cut, the whole ``copies`` each takes, and the words ``more`` of a last, partial one."""
    cuts, _ = write_shared(cuts, "cuts")
    if cuts.count() <= BROADCAST_SOURCES:  # a row of some 100 bytes for each source
        cuts = F.broadcast(cuts)
    placed = rows.join(cuts, ["no_source", "source_key"])
    copies = F.col("epochs") + F.when(F.col("key") < F.col("edge"), 1).otherwise(0)
    more = F.when(F.col("key") == F.col("edge"), F.least("size", F.expr("cast(edge_take * cast(size as decimal(20, 0)) div greatest(edge_size, 1) as bigint)"))).otherwise(F.lit(0))
    return placed.withColumns({"copies": copies, "more": more})


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``id_col, size, source_size, target, taken`` for every row of ``df``.

    ``size`` is the number of words; ``taken`` the words that the mix takes: ``size`` for
    each whole epoch, and in the last epoch the document's part of the prefix (in hash
    order) that fills the budget, floor(target), to the word.

    Null or empty texts have size 0 and are taken 0 times; a null source is a source of its
    own; an empty table gives an empty one.  Rows that repeat an id share a key, and what the
    key takes by size, rounded down, so reruns agree.  Other columns are not read.
    """
    # A narrow table, written once: texts are read once.
    narrow, _ = write_shared(_keyed(df, id_col, text_col, source_col, [F.col(id_col).alias("id")]), "mix")
    placed = _with_cuts(narrow, mixture_cuts(narrow, max_epochs))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies") + F.col("more")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    parts = F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " ", -1)

    def add(a, x):
        done = F.struct((a["words"] + F.when(x != "", 1).otherwise(0)).cast("long").alias("words"), (a["chars"] + F.char_length(x) + 1).cast("long").alias("chars"))
        return F.when(a["words"] >= n, a).otherwise(done)

    walked = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("chars")), add)
    return text.substr(F.lit(1), (walked["chars"] - 1).cast("int"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row for every whole copy of a document that it
    takes, and one with the first words of a document that fills a budget.  Documents of size 0
    go.  ``n_chars``, where there is one, follows the text that is cut.  Texts are not shuffled.
    """
    narrow, _ = write_shared(_keyed(df, id_col, text_col, source_col, []), "mix")
    rows = _keyed(df, id_col, text_col, source_col, [F.struct(*[F.col(c) for c in df.columns]).alias("row")])
    placed = _with_cuts(rows, mixture_cuts(narrow, max_epochs)).where("size > 0 AND (copies > 0 OR more > 0)")
    whole = F.array_repeat(F.lit(0).cast("long"), F.col("copies").cast("int"))
    every = placed.select("row", F.explode(F.when(F.col("more") > 0, F.array_append(whole, F.col("more"))).otherwise(whole)).alias("words"))
    cut = F.when(F.col("words") > 0, first_words(F.col("row")[text_col].cast("string"), F.col("words"))).otherwise(F.col("row")[text_col])
    made = every.select("row", "words", cut.alias("cut_text"))
    changed = {text_col: F.col("cut_text")}
    if "n_chars" in df.columns:
        changed["n_chars"] = F.when(F.col("words") > 0, F.char_length("cut_text").cast(df.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return made.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in df.columns])


def op9_mixing(spark, sf_dir) -> DataFrame:
    return mix(documents(spark, sf_dir))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, source IS NULL AS no_source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), totals AS (
  SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL
), ranked AS (
  SELECT *, CAST((row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1 AS DOUBLE) AS weight,
    CAST(source_size * 3 AS DOUBLE) AS cap FROM totals
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, no_source, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), targets AS (
  SELECT no_source, source, source_size,
    least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM levels WHERE level * weight <= cap) * weight, cap)) AS target
  FROM levels
), placed AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.no_source, s.source ORDER BY s.key, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN targets t ON s.no_source = t.no_source AND s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (budget // greatest(source_size, 1))
  + greatest(0, least(size, budget - (budget // greatest(source_size, 1)) * source_size - ahead)) AS BIGINT) AS taken
FROM placed
"""
