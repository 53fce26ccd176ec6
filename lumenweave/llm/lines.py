"""Operator 8 (native): removal of cross-site boilerplate lines by distinct-site spread.

A line's spread is the number of distinct sites (here ``source``) that carry it. Sites
are gathered per line hash in HyperLogLog sketches, partially aggregated before the
shuffle and merged after it, so a line that holds a third of all rows costs one sketch
per task. A line whose estimate lies within the sketch's error of ``min_sites`` gets an
exact distinct count of its sites; the others are decided by the estimate. Exact copies of
a document count once (with the site of the smallest id, null ids last), so a copied document does not
turn its own text into boilerplate. A document left without any other line is kept
whole and reported (``only_boilerplate``): near-duplicate removal judges it.

Joins with the judged lines are broadcasts while their counted rows are few
(``common.small``); beyond that both sides shuffle, so that a hot line's rows can be split.

Lines are what ``\\n`` separates, compared after trimming spaces, tabs and ``\\r``; blank
lines never go. Cases: null text stays null with 0 lines; null sites are no sites; an
empty table gives an empty result; repeated rows and null ids each keep their row; further
columns pass through ``strip`` and, whatever their names, through ``stage``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import apart, cut, read, small, stow

MIN_SITES = 10
LG_K = 12
#: Four standard errors of a sketch with 2**LG_K registers, and one site.
BAND = 4 * 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def _trim(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r", "  "))


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), F.length(line), line).alias("h2")]


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(h1, h2) of the lines on at least ``min_sites`` distinct sites."""
    # a copy is told from others of its text by its id, null ids last, and its site
    who = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.col(site).alias("site"))
    own = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("doc"), text).alias("t2"), F.xxhash64(F.col(id_col).isNull(), id_col, F.col(site).isNull(), site).alias("copy")]
    copies = docs.filter(F.col(text).isNotNull()).select(*own, who.alias("who"))
    first = copies.groupBy("t1", "t2").agg(F.min_by("copy", "who").alias("kept"), F.count("*").alias("n")).filter("n > 1").select(apart("t1"), apart("t2"), "kept")
    # only texts with copies are looked up again; the others stand for themselves
    spare = small(cut(copies.join(first, ["t1", "t2"]).filter("copy != kept").select("t1", "t2", "copy").distinct()))
    rows = docs.select(*own, F.col(site).alias("site"), F.explode(F.transform(_lines(text), _trim)).alias("line"))
    rows = rows.filter("line != '' AND site IS NOT NULL").join(spare, ["t1", "t2", "copy"], "left_anti").select(*_keys(F.col("line")), "site")
    spread = rows.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = cut(spread.filter(F.col("sites") >= min_sites * (1 - BAND) - 1))
    sure = F.col("sites") > min_sites * (1 + BAND) + 1
    unsure = small(cut(spread.filter(~sure).select("h1", "h2")))
    near = rows.join(unsure, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return spread.filter(sure).select("h1", "h2").unionAll(near.select("h1", "h2"))


def _judged(docs: DataFrame, min_sites: int, site: str, id_col: str, text: str) -> DataFrame:
    """``docs`` with private columns: __lines, __gone (positions of boilerplate lines, null without any), __kept (null if nothing goes)."""
    bad = stow(boilerplate(docs, min_sites, site, id_col, text))
    placed = docs.select(F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit("doc"), text).alias("__t2"), F.posexplode(F.transform(_lines(text), _trim)).alias("pos", "line")).filter("line != ''")
    placed = placed.select("__t1", "__t2", "pos", *_keys(F.col("line")))
    # what a text loses depends on the text alone, so copies share a row
    gone = placed.join(small(bad), ["h1", "h2"], "left_semi").groupBy("__t1", "__t2").agg(F.collect_set("pos").alias("__gone")).select(apart("__t1", "__a"), apart("__t2", "__b"), "__gone")
    out = docs.join(gone, (F.xxhash64(text) == F.col("__a")) & (F.xxhash64(F.lit("doc"), text) == F.col("__b")), "left").drop("__a", "__b")
    kept = F.filter("__lines", lambda line, i: ~F.array_contains("__gone", i))
    other = F.exists(kept, lambda line: _trim(line) != "")
    return out.withColumn("__lines", _lines(text)).withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.when(other, kept)))


def _cleaned(text: str) -> Column:
    return F.coalesce(F.array_join("__kept", "\n"), F.col(text))


def strip(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``; n_lines, n_removed and only_boilerplate are added (clashing names are replaced)."""
    out = _judged(docs, min_sites, site, id_col, text)
    new = {
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long"),
        "n_removed": F.when(F.col("__kept").isNull(), 0).otherwise(F.size("__gone")).cast("long"),
        "only_boilerplate": F.col("__gone").isNotNull() & F.col("__kept").isNull(),
        text: _cleaned(text),
    }
    return out.withColumns(new).drop("__lines", "__gone", "__kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: boilerplate lines go, n_chars follows; no document goes and no other column changes."""
    out = _judged(docs, MIN_SITES, "source", "doc_id", "text").withColumns({"text": _cleaned("text")})
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


_TRIM = "trim(translate({}, chr(9) || chr(13), '  '))"
_BOILERPLATE = f"""
firsts AS (SELECT text, min(doc_id) AS doc_id FROM {{docs}} WHERE text IS NOT NULL GROUP BY text),
spread AS (
  SELECT line FROM (
    SELECT {_TRIM.format("l")} AS line, source
    FROM (SELECT d.source, unnest(string_split(d.text, chr(10))) AS l FROM {{docs}} d JOIN firsts f ON d.doc_id = f.doc_id AND d.text = f.text)
  ) WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
),
flat AS (
  SELECT doc_id, i, l, {_TRIM.format("l")} AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM {{docs}})
),
judged AS (SELECT doc_id, i, l, line, line <> '' AND line IN (SELECT line FROM spread) AS bad FROM flat),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, count(*) FILTER (NOT bad AND line <> '') AS n_other,
         string_agg(l, chr(10) ORDER BY i) FILTER (NOT bad) AS body
  FROM judged GROUP BY doc_id
)"""

ORACLE = f"""
WITH {_BOILERPLATE.format(docs="documents")}
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines,
       CASE WHEN k.n_other > 0 THEN k.n_bad ELSE 0 END::BIGINT AS n_removed,
       sha256(CASE WHEN k.n_bad > 0 AND k.n_other > 0 THEN k.body ELSE coalesce(d.text, '') END) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
