"""What the operators' results must obey, as queries that SQL can check.

SQL can't make these operators' choices, but it can say which rows there must
be, their sizes and targets, and that no rule is broken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import mixing, packing, quality, repeats, sharding, toxicity

#: Words of a text and their number, in DuckDB.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_counts(spark, sf_dir: str) -> DataFrame:
    """``op7``'s counts and base rules of every document."""
    return quality.op7(spark, sf_dir).select("doc_id", *quality.COUNTS, "base_failed")


QUALITY_COUNTS_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d),
g AS (SELECT r, i FROM i QUALIFY count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) > 1),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM g, range(3) t(j) GROUP BY r),
b AS (SELECT r, doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed FROM b LEFT JOIN c USING (r)
"""


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """Each source of ``op8``: its size and target, whether its words come near it, and whether no row is taken too often."""
    rows = mixing.op8(spark, sf_dir)
    per = rows.groupBy("source", "source_size", F.round("target", 3).alias("target")).agg(F.sum("taken").alias("taken"), F.max("size").alias("longest"), F.max(F.col("taken") > 3 * F.col("size")).alias("over"))
    return per.select("source", "source_size", "target", (F.abs(F.col("taken") - F.col("target")) <= F.col("longest")).alias("near"), "over")


#: The water level: sources are stopped in the order of 3 * size / weight, and the others share what is left by weight.
MIX_TARGETS_SQL = rf"""
WITH s AS (SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(size) OVER () AS total FROM s),
o AS (SELECT *, 3.0 * size / weight AS level, sum(3 * size) OVER (ORDER BY 3.0 * size / weight, source NULLS LAST) AS stopped, sum(weight) OVER (ORDER BY 3.0 * size / weight DESC, source DESC NULLS FIRST) - weight AS open_ FROM w),
l AS (SELECT level, (total - stopped) / nullif(open_, 0) AS next_ FROM o),
f AS (SELECT coalesce(min(next_) FILTER (next_ >= level AND next_ <= (SELECT min(level) FROM o p WHERE p.level > l.level)), NULL) AS level FROM l),
z AS (SELECT CASE WHEN total <= min(level) * sum(weight) THEN total * 1.0 / sum(weight) END AS level FROM o GROUP BY total)
SELECT source, size AS source_size, round(least(3.0 * size, coalesce((SELECT level FROM z), (SELECT level FROM f), 1e300) * weight), 3) AS target, true AS near, false AS over FROM o
"""


def shard_law(spark, sf_dir: str) -> DataFrame:
    """One row about ``op2``: rows, bytes, shards, places without a gap, and bytes equal but for one row's."""
    rows = sharding.op2(spark, sf_dir)
    per = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.countDistinct("slot").alias("places"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.max("size").alias("longest"))
    gapless = F.min((F.col("places") == F.col("n")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1))
    even = F.max("bytes") - F.min("bytes") <= F.max("longest")
    return per.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), gapless.alias("gapless"), even.alias("even"))


SHARD_LAW_SQL = "SELECT count(*) AS n, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes, CAST(8 AS BIGINT) AS shards, true AS gapless, true AS even FROM documents"


def packing_law(spark, sf_dir: str) -> DataFrame:
    """One row about ``op4``: words, sequences that are too full, places that overlap or leave a gap, documents."""
    rows = packing.op4(spark, sf_dir)
    bins = rows.where("bin_id IS NOT NULL").groupBy("bin_id").agg(F.sum("length").alias("words"), F.max(F.col("offset") + F.col("length")).alias("reach"), F.countDistinct("offset").alias("places"), F.count("*").alias("n"))
    held = bins.agg(F.sum("words").alias("words"), F.count_if(F.col("words") > packing.CAPACITY).alias("too_full"), F.count_if((F.col("reach") != F.col("words")) | (F.col("places") != F.col("n"))).alias("gaps"))
    return held.crossJoin(rows.agg(F.countDistinct("doc_id").alias("documents")))  # one row each


PACKING_LAW_SQL = f"SELECT CAST(sum(len({_WORDS})) AS BIGINT) AS words, CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS gaps, count(DISTINCT doc_id) AS documents FROM documents"


def toxicity_rows(spark, sf_dir: str) -> DataFrame:
    """Every row of ``op5`` once, with a score from 0 to 1 that its prediction follows."""
    rows = toxicity.op5(spark, sf_dir)
    return rows.select("doc_id", (F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= 0.3).cast("int"))).alias("sound"))


TOXICITY_ROWS_SQL = "SELECT doc_id, true AS sound FROM documents"


def repeat_rows(spark, sf_dir: str) -> DataFrame:
    """Every row of ``op6``: its bytes, whether no more is removed than there is, and whether spans are as long as a repeat."""
    rows = repeats.op6(spark, sf_dir)
    sound = (F.col("n_removed") <= F.col("n_bytes")) & (F.col("n_removed") >= repeats.MIN_LENGTH * F.col("n_spans")) & ((F.col("n_spans") > 0) == (F.col("n_removed") > 0))
    return rows.select("doc_id", "n_bytes", sound.alias("sound"))


REPEAT_ROWS_SQL = "SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, true AS sound FROM documents"
