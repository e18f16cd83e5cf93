"""Removal of boilerplate lines by their spread over sites.

A line that many distinct sites carry is boilerplate. Each line's hash gathers a HyperLogLog sketch of the
sites that hold it; sketches merge in the aggregation, before and after the shuffle. Where the estimate is
near the threshold, the sites are counted exactly, so the decisions are those of exact counts. Of a
boilerplate line the first occurrence in the corpus stays, so no content is lost where whole documents were
copied from site to site; every other occurrence goes.

Only DataFrame operations are used. A line that half of all documents hold meets in partial aggregates
before the shuffle. Joins on line hashes broadcast the few lines in question where their count is checked to be
small, so no line is shuffled for them; else they are plain equi-joins, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, table

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: Estimates within this factor of the threshold are counted exactly; the sketch's error is under 0.07 (lg 9 registers).
NEAR, LG_REGISTERS = 2.0, 9
#: ASCII white space at a line's ends is not part of it.
BLANK = " \t\n\x0b\x0c\r"


def _key(line: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a line."""
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines that are not blank: doc_id, t (hash of the text), site, pos (from 0), h1, h2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # What concerns the whole text is computed below the generator, once a document; above it, once a line.
    whole = docs.select("doc_id", F.xxhash64(text).alias("t"), F.coalesce(F.col("source"), F.lit("")).alias("site"), F.split(text, "\n").alias("parts"))
    parts = whole.select("doc_id", "t", "site", F.posexplode("parts").alias("pos", "line"))
    trimmed = F.trim(F.col("line"), F.lit(BLANK))
    return parts.withColumn("line", trimmed).filter(F.col("line") != "").select("doc_id", "t", "site", "pos", *_key(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (h1, h2) of the lines on ``min_sites`` or more distinct sites, and each one's first place."""
    first = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id"), F.col("pos"), F.col("t"))
    # A line on one site needs no sketch; this leaves the few lines that are on several.
    several = lines.groupBy("h1", "h2").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    several = cut(several.filter((F.col("lo") != F.col("hi")) & (F.col("n") >= min_sites)).select("h1", "h2", "first"))
    held = lines.join(broadcast_if_small(several.select("h1", "h2")), ["h1", "h2"], "left_semi")
    spread = held.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS))).alias("sites"))
    spread = cut(spread.filter(F.col("sites") * NEAR >= min_sites))
    near = broadcast_if_small(spread.filter(F.col("sites") < min_sites * NEAR).select("h1", "h2"))
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
    sure = spread.filter(F.col("sites") >= min_sites * NEAR).select("h1", "h2")
    chosen = sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("h1", "h2"))
    return several.join(chosen, ["h1", "h2"], "left_semi")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``, and n_lines, n_removed (longs) added.

    Lines are those between ``\\n``; blank ones are never boilerplate and stay. A null text stays null with
    no lines; a null source is one site. Rows that agree in doc_id and text are treated alike: if they hold
    a line's first place, each keeps it. Other columns pass through; columns named as the added ones are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = lines_of(docs)
    bad = broadcast_if_small(cut(boilerplate(lines, min_sites)).withColumnsRenamed({"h1": "b1", "h2": "b2"}))
    hit = lines.join(bad, (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")))
    kept = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.pos") == F.col("pos")) & (F.col("first.t") == F.col("t"))
    gone = hit.filter(~kept).groupBy(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).agg(F.collect_set("pos").alias("__gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__h", F.xxhash64(text))
    out = keyed.join(gone, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__t")), "left")
    # Both lists are bound once, and the places that stay are found by hashing: linear in a text's lines.
    parts = F.split(F.col("text"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    left = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay, lambda i: F.get(p, i)), "\n")), F.lit(0))
    n_lines = F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANK)) != "")), F.lit(0)).cast("long")
    return out.select(
        *[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else docs[c] for c in docs.columns],
        n_lines.alias("n_lines"),
        F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("n_removed"),
    )


def op6_lines(spark, sf_dir: str) -> DataFrame:
    """Of every document: n_lines, n_removed, and the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "text")


OP6_SQL = r"""
WITH p AS (
  SELECT doc_id, text, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
  SELECT doc_id, site, unnest(range(len(parts))) AS pos, trim(unnest(parts), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM p
), b AS (
  SELECT line, arg_min(struct_pack(doc_id, pos), struct_pack(doc_id, pos)) AS first
  FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10
), g AS (
  SELECT doc_id, list(pos) AS gone FROM l JOIN b USING (line) WHERE struct_pack(doc_id, pos) <> b.first GROUP BY doc_id
)
SELECT p.doc_id,
       len(list_filter(parts, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''))::BIGINT AS n_lines,
       coalesce(len(gone), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(len(parts)), lambda i: NOT list_contains(gone, i)), lambda i: parts[i + 1]), chr(10)), '') END AS text
FROM p LEFT JOIN g USING (doc_id)
"""
