"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Within each source the keys are split in
ranges and sorted, word counts are summed up to each row, and the source is cut
at exactly its budget: whole epochs first, then the rows before the cut, of the
row at the cut its first words.

The keys are uniform, so equal ranges of keys hold about equal numbers of rows;
a source of n rows has about sqrt(n) ranges. Hence the running sum over ranges
and the one inside a range both see about sqrt(n) rows in a group, however large
a source is.

Defined cases: a null text has size 0; the null source is a source and comes
last. A source of size 0 has target 0. Rows that repeat doc_id and size are
interchangeable. Columns of the same name as a result are replaced in the query
and left alone by ``draw``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treeshift.llm.common import WORD, staged

#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000
KEY_DIGITS = 15


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _keyed(docs: DataFrame, size: Column) -> DataFrame:
    """Adds the source as a non-null text, the size and the random key as a number."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.withColumns(
        {
            "__source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")),
            "__size": size,
            "__key": F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("bigint"),
        }
    )


def source_targets(
    sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Word budget of each row of ``sources`` (source, source_size).

    Weights repeat over the sources by code point. What a source cannot take
    within ``cap`` times its size goes to the others by weight. That is the
    level at which sum(min(cap * size, level * weight)) is the total: sources
    are filled up in order of size over weight, and the first that does not
    fill up has the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("__most") / F.col("__weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("__most").over(before), F.lit(0.0))) / (
        F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    )
    full = F.col("__most") <= F.col("__level") * F.col("__weight")
    return (
        sources.withColumn("__weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("__most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("__level", level)
        .withColumn("__common", F.max(F.when(~full, F.col("__level"))).over(everything))
        .withColumn("target", F.when(full, F.col("__most")).otherwise(F.col("__common") * F.col("__weight")))
        .drop("__weight", "__most", "__level", "__common")
    )


def mix(docs: DataFrame, size: Column | None = None, **targets) -> DataFrame:
    """``docs`` with __size, source_size, target and __taken (words the mix takes of the row)."""
    rows = _keyed(docs, words() if size is None else size)
    narrow = staged(rows.select("source", "__source", "__size", "__key"), "mix-sizes")
    sources = staged(
        source_targets(
            narrow.groupBy("source", "__source").agg(
                F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("__rows")
            ),
            **targets,
        ).drop("source"),
        "mix-sources",
    )
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    part = F.floor(F.col("__key") / F.lit(float(16**KEY_DIGITS)) * F.ceil(F.sqrt("__rows"))).cast("bigint")

    def in_ranges(df: DataFrame) -> DataFrame:
        return df.join(sources, "__source").withColumn("__range", part)

    ahead = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        in_ranges(narrow)
        .groupBy("__source", "__range")
        .agg(F.sum("__size").alias("__sum"))
        .withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)))
        .drop("__sum")
    )
    inside = (
        Window.partitionBy("__source", "__range")
        .orderBy("__key", "doc_id", "__size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - F.col("__epochs") * F.col("source_size") + 0.5).cast("bigint")
    left = F.col("__rest") - F.col("__ahead") - F.coalesce(F.sum("__size").over(inside), F.lit(0))
    return (
        in_ranges(rows)
        .join(offsets, ["__source", "__range"])
        .withColumn("__epochs", epochs.cast("bigint"))
        .withColumn("__rest", rest)
        .withColumn("__left", left)
        .withColumn(
            "__taken",
            F.col("__epochs") * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__left"))),
        )
        .drop("__source", "__key", "__rows", "__range", "__ahead", "__epochs", "__rest", "__left")
    )


def mixture(docs: DataFrame, **targets) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken."""
    sizes = staged(docs.select("doc_id", "source", words().alias("size")), "mix-words")
    return mix(sizes, F.col("size"), **targets).select(
        "doc_id", "size", "source_size", "target", F.col("__taken").alias("taken")
    )


def draw(docs: DataFrame, **targets) -> DataFrame:
    """The mix itself: each row as often as it is taken, the last time perhaps only its first words.

    Rows without words are never taken. ``n_chars``, where there is one, follows a cut text.
    """
    names = {"source_size": "__source_size", "target": "__target"}
    kept = {c: f"__own_{c}" for c in docs.columns if c in names}
    held = docs.withColumnsRenamed(kept)
    mixed = mix(held, **targets)
    copies = F.ceil(F.col("__taken") / F.col("__size")).cast("int")
    part = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    first_words = F.array_join(
        F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), part.cast("int")), ""
    )
    cut = part < F.col("__size")
    mixed = (
        mixed.filter(F.col("__taken") > 0)
        .drop("source_size", "target")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
        .withColumn("text", F.when(cut, first_words).otherwise(F.col("text")))
    )
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn(
            "n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        )
    return mixed.withColumnsRenamed({v: k for k, v in kept.items()}).select(docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 15) AS rnd
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lev
  FROM sources
  WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN most <= lev * w THEN most ELSE max(lev) FILTER (WHERE most > lev * w) OVER () * w END AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT doc_id, size, source_size, target, epochs,
         CAST(floor(target - epochs * source_size + 0.5) AS BIGINT)
         - coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY rnd, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken
FROM running
"""
