"""Cross-site line dedup by distinct-site spread. DataFrame functions only.

Lines are told apart by hashes of their trimmed text (64 and 32 bits and the length). A HyperLogLog
sketch of the sites for each line merges by aggregation, on the map side first, so a line that a
third of all documents hold is one sketch per task. Where the estimate is well over ``min_sites`` or
well under it, it decides; lines within the error band (six standard errors, and one site at least)
get an exact distinct count. Lines seen on ``min_sites`` sites or more are boilerplate: their first
occurrence stays (least doc_id, hash of the text and line number) and every other goes.

Defined results: a null text stays null and has no lines; blank lines stay; a null source is no
site; a text whose lines all go becomes empty; rows equal in doc_id and text are one document and
lose the same lines; lines are counted once a site, however often they repeat. All columns of the
input are carried along, whatever their names, and columns named like the added ones are replaced.

The lines' keys are written once and read by each of the three steps that need them; texts are split twice, for that and
for the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.names import free
from weftgraph.storage import cut

LG_K = 11
#: Relative error of six standard errors of the sketch.
BAND = 6 * 1.04 / (1 << LG_K) ** 0.5
_SPACE = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _keyed(documents: DataFrame) -> DataFrame:
    """Every non-blank line: its key, its document's key, its number and its site."""
    at = F.posexplode(F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(_SPACE)))).alias("pos", "line")
    lines = documents.where("text is not null").select("doc_id", F.xxhash64("text").alias("check"), F.col("source").alias("site"), at).where("line <> ''")
    return lines.select(F.xxhash64("line").alias("a"), F.hash("line").alias("b"), F.length("line").alias("c"), "doc_id", "check", "pos", "site")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """``(a, b, c, first)``: keys of lines on at least ``min_sites`` sites, and where each is first."""
    key = ["a", "b", "c"]
    place = F.struct("doc_id", "check", "pos")
    spread = lines.groupBy(*key).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(place).alias("first"), F.count("*").alias("n"))
    spread = cut(spread.where(F.col("n") >= min_sites).select(*key, "first", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    low, high = min_sites - max(1.0, BAND * min_sites), min_sites + max(1.0, BAND * min_sites)
    near = spread.where(F.col("sites").between(low, high)).select(*key, "first")
    exact = lines.select(*key, "site").join(near.select(*key), key, "left_semi").where("site is not null").distinct().groupBy(*key).agg(F.count("*").alias("exact"))
    sure = spread.where(F.col("sites") > high).select(*key, "first")
    return sure.unionByName(near.join(exact.where(F.col("exact") >= min_sites).select(*key), key).select(*key, "first"))


def dedup_lines(documents: DataFrame, min_sites: int = 5) -> DataFrame:
    """``documents`` with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_removed``."""
    docs = documents.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string"), "source": F.col("source").cast("string")})
    docs = docs.drop("n_lines", "n_removed")
    lines = cut(_keyed(docs.select("doc_id", "text", "source")), "lines")
    spread = cut(boilerplate(lines, min_sites), "boilerplate")
    doc, check, gone, own = free([*docs.columns, "n_lines", "n_removed"], "doc", "check", "gone", "lines")
    here = F.struct("doc_id", "check", "pos")
    out = lines.join(spread, ["a", "b", "c"]).where(~here.eqNullSafe(F.col("first")))
    out = out.groupBy(F.col("doc_id").alias(doc), F.col("check").alias(check)).agg(F.collect_set("pos").alias(gone))
    out = docs.join(out, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(check)), "left")
    every = F.sequence(F.lit(0), F.size(own) - 1)
    left = F.array_join(F.transform(F.array_except(every, gone), lambda i: F.get(own, i)), "\n")
    out = out.withColumn(own, _lines(F.col("text")))
    out = out.withColumns({
        "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(left),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(own)).cast("long"),
        "n_removed": F.greatest(F.lit(0), F.coalesce(F.size(gone), F.lit(0))).cast("long"),
    })
    return out.drop(doc, check, gone, own)


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH l AS (
  SELECT doc_id, text, source, pos, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM (
    SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)
), b AS (
  SELECT line, min({'doc_id': doc_id, 'pos': pos}) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5
), j AS (
  SELECT l.doc_id, l.pos, b.line IS NOT NULL AND {'doc_id': l.doc_id, 'pos': l.pos} <> b.first AS gone FROM l LEFT JOIN b ON l.line = b.line
), r AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM j GROUP BY doc_id
), k AS (
  SELECT j.doc_id, string_agg(x.line, chr(10) ORDER BY j.pos) AS text FROM j JOIN (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) x
  ON x.doc_id = j.doc_id AND x.pos = j.pos WHERE NOT gone GROUP BY j.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
