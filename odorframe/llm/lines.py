"""Removal of multi-line chunks that repeat anywhere in the corpus.

A chunk ends behind a line where a rolling hash over the last two line hashes says so, hence a
passage is cut alike wherever it stands, but for its first lines. Chunk digests are grouped;
chunks of repeated digests are compared by their bytes; all but the first occurrence go.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common

# A boundary follows a line if the first hex digit of its rolling hash is below this one.
BELOW = "8"
# Chunks of fewer lines stay.
LEAST_LINES = 2
# Lines travel with a blank in front, so that a line of the mark alone can only be a boundary.
MARK = "#"


def chunks(text: str = "text") -> Column:
    """The chunks of a text: an array of strings, each line with a blank in front."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    hashes = F.transform(lines, lambda line: F.md5(line))
    before = F.concat(F.array(F.lit("")), hashes)
    # zip_with pads the shorter side with a null: the place behind the last line, dropped here.
    ends = F.zip_with(before, hashes, lambda b, h: F.substring(F.md5(F.concat(b, h)), 1, 1) < BELOW)
    marked = F.zip_with(lines, ends, lambda line, end: F.when(line.isNull(), None).when(end, F.concat(F.lit(" "), line, F.lit("\n" + MARK))).otherwise(F.concat(F.lit(" "), line)))
    joined = F.array_join(F.filter(marked, lambda x: x.isNotNull()), "\n")
    # A boundary behind the last line is none.
    return F.split(F.regexp_replace(joined, "\n" + MARK + "\\z", ""), "\n" + MARK + "\n", -1)


def _lines_of(chunk: str) -> Column:
    return (F.octet_length(chunk) - F.octet_length(F.replace(F.col(chunk), F.lit("\n"), F.lit(""))) + 1).cast("long")


def deduplicate(docs: DataFrame, row: str | None = None, least_lines: int = LEAST_LINES) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_lines, n_removed, n_chunks_removed, kept.

    Lines end at ``\\n``; a null text is one empty line. Of equal chunks of ``least_lines`` lines or
    more the first by (doc_id with null last, row, place) stays, within one text too. Chunks whose
    digests agree but whose bytes differ stay. A text loses its chunks' lines, the rest is joined
    again by ``\\n``; if all go, the text is empty.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    source = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), chunks().alias("chunks"))
    pieces = source.select("row", "doc_id", F.posexplode("chunks").alias("place", "chunk")).withColumn("n_lines", _lines_of("chunk"))
    pieces = pieces.filter(F.col("n_lines") >= least_lines).withColumn("digest", F.unhex(F.sha2("chunk", 256)))
    slim = common.written(pieces.select("row", "doc_id", "place", "n_lines", "digest"), "line-chunks")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "place")
    again = slim.groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    again = common.written(again, "line-again")
    # Grouping by the whole chunk is the byte comparison; copies meet map-side first.
    bodies = common.only(pieces.select("digest", "chunk"), again.select("digest"), "digest")
    texts = bodies.groupBy("digest", "chunk").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts"))
    same = texts.filter("texts = 1").select("digest")
    gone = slim.join(again.join(same, "digest", "left_semi"), "digest")
    gone = gone.filter((F.col("row") != F.col("first.row")) | (F.col("place") != F.col("first.place")))
    per_row = gone.groupBy("row").agg(F.collect_list("place").alias("gone"), F.sum("n_lines").alias("n_removed"))
    out = source.join(common.beside(per_row, "line-gone"), "row", "left")
    left = F.when(F.col("gone").isNull(), F.col("chunks")).otherwise(F.filter("chunks", lambda c, i: ~F.array_contains(F.col("gone"), i)))
    whole = F.array_join("chunks", "\n")
    return out.select(
        "row",
        "doc_id",
        (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_chunks_removed"),
        F.regexp_replace(F.array_join(left, "\n"), "(?md)^ ", "").alias("kept"),
    ).withColumn("n_chunks_removed", F.greatest("n_chunks_removed", F.lit(0).cast("long")))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
e AS (SELECT *, left(md5(coalesce(lag(md5(line)) OVER w, '') || md5(line)), 1) < '8' AS ends FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e),
k AS (SELECT doc_id, place, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY ALL),
g AS (
  SELECT doc_id, place, n, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone FROM k WHERE n >= 2)
SELECT c.doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(g.gone, false)) AS n_removed,
       count(DISTINCT c.place) FILTER (coalesce(g.gone, false)) AS n_chunks_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(g.gone, false)), '')) AS kept_sha256
FROM c LEFT JOIN g USING (doc_id, place) GROUP BY c.doc_id
"""
