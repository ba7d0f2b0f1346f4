"""Remove repeated passages of three lines, with DataFrame functions only.

Method: overlapping three-line windows. Every three consecutive lines are hashed; windows that occur
more than once anywhere are found by grouping, the first one in order of (doc_id, line) stays, and the
lines that later ones cover are merged and removed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.cluster import settle

WINDOW_LINES = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _windows(documents: DataFrame) -> DataFrame:
    """(doc_id, at, k1, k2) for each window; the two hashes are its key. Three empty lines are none."""
    at = F.when(F.size("lines") >= WINDOW_LINES, F.sequence(F.lit(0), F.size("lines") - WINDOW_LINES)).otherwise(F.array().cast("array<int>"))
    lines = documents.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", _lines("text").alias("lines"))
    parts = [F.col("lines")[F.col("at") + k] for k in range(WINDOW_LINES)]
    return (lines.select("doc_id", "lines", F.explode(at).alias("at"))
            .filter(F.concat(*parts) != "")
            .select("doc_id", "at", F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(2), *parts).alias("k2")))


def repeated_lines(documents: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept, columns of ``carry``) for each row of ``documents`` (doc_id, text).

    Lines are split at ``\\n`` and compared as they are. ``kept`` joins the lines that stay by ``\\n``; it
    is "" if all go. Texts of fewer lines have no window and lose nothing; null texts have 0 lines and
    a null ``kept``. Rows of one doc_id are one document: their windows at equal lines count as one
    place, and what goes, goes from all of them. Rows without doc_id lose nothing. Other columns are
    ignored; an empty table gives no rows.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                                 F.struct(F.lit(0).alias("__none"), *carry).alias("carry"))
    windows = _windows(documents)
    # counted before the shuffle, so a passage of many documents sends a row per task
    firsts = settle(windows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max(F.struct("doc_id", "at")).alias("last"))
                    .filter("first < last").drop("last"))
    later = windows.join(firsts, ["k1", "k2"]).filter(F.struct("doc_id", "at") > F.col("first"))
    places = later.groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    covered = F.flatten(F.transform("places", lambda i: F.array(*(i + k for k in range(WINDOW_LINES)))))
    count = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), count - 1), covered)
    split = documents.join(places, "doc_id", "left").select("doc_id", "text", "carry", "places", _lines("text").alias("lines"))
    return (split.withColumn("stay", F.when(F.col("places").isNotNull() & F.col("text").isNotNull(), stay))
            .select("doc_id",
                    F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
                    F.when(F.col("stay").isNull(), 0).otherwise(count - F.size("stay")).cast("long").alias("n_removed"),
                    F.when(F.col("stay").isNull(), F.col("text")).otherwise(
                        F.array_join(F.transform("stay", lambda i: F.col("lines")[i]), "\n")).alias("kept"),
                    *(F.col("carry")[name].alias(name) for name in carry)))


ORACLE = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
spread AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM split WHERE text IS NOT NULL),
windows AS (SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS body FROM spread),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS place
                                  FROM windows WHERE body <> chr(10) || chr(10)) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) t(k)),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM split),
kept AS (SELECT n.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
                coalesce(string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
         FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
