"""Exports of an archive and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import index


def page_lines(pages: DataFrame, file: str = "capture_id", order: str = "url") -> DataFrame:
    """JSON lines of pages with the byte ``offset`` and ``length`` that each has in its file."""
    line = F.to_json(F.struct(*[c for c in pages.columns if c != file]))
    rows = pages.select(file, order, line.alias("line")).withColumn("length", F.octet_length("line") + 1)
    return rows.withColumn("offset", F.coalesce(F.expr(f"sum(length) OVER (PARTITION BY {file} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)))


def write_index(records: DataFrame, path: str, patterns: list[str] = ()) -> None:
    """The sorted index as Parquet, without what is withheld or an engine's own; ranges of keys are files."""
    kept = index.without(records.where(~index.bookkeeping()), list(patterns))
    kept.orderBy("urlkey", "timestamp").write.mode("overwrite").parquet(path)


def unique_names(files: DataFrame) -> DataFrame:
    """(``path``, ``name``): the base name, with its capture before it where two would clash, numbered if they still do."""
    base = F.element_at(F.split("path", "/"), -1)
    capture = F.element_at(F.split("path", "/"), -2)
    rows = files.select("path", base.alias("base"), capture.alias("capture"))
    rows = rows.withColumn("name", F.when(F.expr("count(*) OVER (PARTITION BY base)") > 1, F.concat_ws("-", "capture", "base")).otherwise(F.col("base")))
    n = F.expr("row_number() OVER (PARTITION BY name ORDER BY path)")
    return rows.select("path", F.when(n == 1, F.col("name")).otherwise(F.concat_ws("-", n.cast("string"), F.col("name"))).alias("name"))


def retargeted(records: DataFrame, names: DataFrame) -> DataFrame:
    """Records with the exported names of their files; an unknown file is an error."""
    to = names.select(F.col("path").alias("filename"), F.col("name").alias("_to"))
    known = F.coalesce("_to", F.raise_error(F.concat(F.lit("unknown file "), F.col("filename"))).cast("string"))
    return records.join(to, "filename", "left").withColumn("filename", known).drop("_to")


def problems(records: DataFrame, contents: DataFrame) -> DataFrame:
    """Index rows that don't lead to a record of their URL: (``url``, ``problem``).

    ``contents``: ``filename``, ``offset``, ``target``.
    """
    there = contents.select("filename", "offset", "target", F.lit(True).alias("_there"))
    rows = records.join(there, ["filename", "offset"], "left")
    what = F.when(F.col("_there").isNull(), "nothing there").when(F.col("target") != F.col("url"), "another page there")
    return rows.select("url", what.alias("problem")).where("problem IS NOT NULL")


def manifest(files: DataFrame) -> DataFrame:
    """(``path``, ``bytes``, ``hash``) of each member of a package (``path``, ``content``)."""
    return files.select("path", F.octet_length("content").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))
