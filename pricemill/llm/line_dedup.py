"""Line deduplication by the number of distinct sites that a line appears on.

Every line's sites go into a HyperLogLog sketch; the sketches of a line merge by aggregation, in the
task that reads the text first, so a line that is everywhere costs one small row a task. Only lines
whose estimate lies near the threshold, where the sketch's error could decide, are counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, free_name, stored, table

#: Distinct sites from which a line is boilerplate; log2 of a sketch's registers.
MIN_SITES, REGISTERS_LOG2 = 10, 11
#: Lines near the threshold that are broadcast at most; more are joined by a shuffle.
SENT_LINES = 1_000_000
_BLANKS = " \t\r\f\v"


def normalised_line(line: Column) -> Column:
    """A-Z lower-cased, ASCII blanks off both ends."""
    return F.btrim(ascii_lower(line), F.lit(_BLANKS))


def _row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("r"), F.hash("text", "doc_id").alias("r2")]


def line_table(docs: DataFrame, site: str) -> DataFrame:
    """(r, r2, doc_id, pos, h, h2, site) of every line of docs: r and r2 stand for the row's doc_id and
    text, h and h2 for the line; h is null for a blank line."""
    # the key is taken before the lines are, once a row
    rows = docs.select(*_row_key(), "doc_id", F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.split("text", "\n", -1).alias("lines"))
    lines = rows.select("r", "r2", "doc_id", "site", F.posexplode("lines").alias("pos", "line"))
    norm = normalised_line(F.col("line"))
    return lines.select(
        "r", "r2", "doc_id", "pos", "site", F.when(norm != "", F.xxhash64(norm)).alias("h"), F.when(norm != "", F.hash(norm)).alias("h2")
    )


def widespread(lines: DataFrame, min_sites: int = MIN_SITES, registers_log2: int = REGISTERS_LOG2) -> DataFrame:
    """(h, h2, first) of the lines on at least min_sites distinct sites; first: the least (doc_id, row, pos)."""
    sketched = (
        lines.where("h is not null")
        .groupBy("h", "h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", registers_log2)).alias("sites"), F.min(F.struct("doc_id", "r", "r2", "pos")).alias("first"))
    )
    # four standard errors of the sketch, and one for rounding
    band = math.ceil(4 * 1.04 / math.sqrt(1 << registers_log2) * min_sites) + 1
    sketched = stored(sketched.where(F.col("sites") >= min_sites - band), "sketches")
    near = sketched.where(F.abs(F.col("sites") - min_sites) <= band)
    pairs, keys = lines.where("h is not null").select("h", "h2", "site"), near.select("h", "h2")
    if near.count() <= SENT_LINES:
        pairs = pairs.join(F.broadcast(keys), ["h", "h2"], "left_semi")
    else:  # a line's rows become its sites before they are dealt by line
        pairs = pairs.distinct().join(keys, ["h", "h2"], "left_semi")
    exact = pairs.distinct().groupBy("h", "h2").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    sure = sketched.where(F.col("sites") > min_sites + band).select("h", "h2", "first")
    return sure.unionByName(near.join(exact, ["h", "h2"]).select("h", "h2", "first"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """The rows and columns of docs with boilerplate lines cut out of text, and __n_lines, __n_removed.

    A line is boilerplate when its normal form (A-Z lower-cased, blanks off both ends) appears on at
    least min_sites distinct sites; a null site counts as one site without a name. With keep_first
    the occurrence of the least (doc_id, place) stays, so that no line is lost to the corpus. Blank
    lines stay. A null text stays null and has no lines; an empty text has one, blank line. A text
    whose lines all go becomes empty. Rows of the same doc_id and text are cut alike. Other columns
    stay, whatever their names (columns __n_lines and __n_removed of docs are replaced); an empty table
    gives an empty one. The lines of one text are held together in memory (13 bytes each), others not.
    """
    r, r2, stays = (free_name(c, docs) for c in ("__r", "__r2", "__stays"))
    lines = stored(line_table(docs, site), "lines")
    common = stored(widespread(lines, min_sites), "common")  # a plain table, so that a hot line's join can be split
    is_first = F.struct("first.r", "first.r2", "first.pos") == F.struct("r", "r2", "pos")
    goes = F.col("first").isNotNull() & ~F.coalesce(is_first, F.lit(False)) if keep_first else F.col("first").isNotNull()
    kept = (
        lines.select("r", "r2", "pos", "h", "h2")
        .join(common.hint("merge"), ["h", "h2"], "left")
        .groupBy("r", "r2")
        .agg(F.array_sort(F.collect_set(F.struct("pos", (~goes).alias("stays")))).alias("kept"))
        .where(F.exists("kept", lambda x: ~x.stays))
        .select(F.col("r").alias(r), F.col("r2").alias(r2), F.col("kept.stays").alias(stays))
    )
    parts = F.split("text", "\n", -1)
    cut = F.array_join(F.filter(parts, lambda line, i: F.element_at(F.col(stays), i + 1)), "\n")
    keyed = docs.withColumns({r: F.xxhash64("doc_id", "text"), r2: F.hash("text", "doc_id")})
    rest = [c for c in docs.columns if c not in ("__n_lines", "__n_removed")]
    return keyed.join(kept, [r, r2], "left").select(
        *(F.when(F.col(stays).isNotNull(), cut).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in rest),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("__n_lines"),
        F.coalesce(F.size(F.filter(stays, lambda x: ~x)), F.lit(0)).cast("long").alias("__n_removed"),
    )


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines cut out and n_chars, if there, set anew; a document of which nothing
    but blanks is left goes, as each of its lines stands in another document. Other documents stay."""
    found = dedup_lines(docs, site, min_sites)
    found = found.where((F.col("__n_removed") == 0) | (F.btrim("text", F.lit(_BLANKS + "\n")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate cut out of every whole text of documents; the source is the site."""
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


OP9_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
n AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS norm FROM l),
s AS (SELECT norm FROM n WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (
  SELECT n.*, s.norm IS NOT NULL AND row_number() OVER (PARTITION BY n.norm ORDER BY doc_id, pos) > 1 AS goes
  FROM n LEFT JOIN s ON n.norm = s.norm),
g AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_removed
  FROM m GROUP BY doc_id)
SELECT d.doc_id, g.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN g USING (doc_id)
"""
