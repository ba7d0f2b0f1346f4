"""Keep or reject texts by a cascade of rules.

Method: short-circuit cascade. Every rule's cost and share of rejections are estimated on a sample;
rules run in descending order of rejections per second, each only on texts that all before it passed.
The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as X
from tidemark.llm.statistics import Statistics

SAMPLE_DOCS = 2000

#: Name and test of each rule; a test marks the rows to reject. All are shares, so length does not matter.
RULES: dict[str, Callable[[Statistics], np.ndarray]] = {
    "long_words": lambda s: s.word_chars > 25 * s.n_words,
    "symbols": lambda s: 5 * s.n_symbols > 2 * s.n_words,
    "repeated_lines": lambda s: 10 * s.n_dup_lines > 7 * s.n_lines,
    "upper_case": lambda s: 5 * s.n_upper > 3 * s.n_letters,
    "exclamations": lambda s: 2 * s.n_of("!") > s.n_words,
    "digits": lambda s: 2 * s.n_digits > s.word_chars,
    "one_word": lambda s: 10 * s.n_top_word > 4 * s.n_words,
}


def base_failed(s: Statistics) -> np.ndarray:
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


def _measure(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in X.slices(batch.column("text")):
                spent, gone = [], []
                for name in names:
                    fresh = Statistics(data, offsets)  # so that no rule finds another's work done
                    begin = time.perf_counter()
                    gone.append(int(RULES[name](fresh).sum()))
                    spent.append(time.perf_counter() - begin)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(spent, pa.float64()), X.longs(np.array(gone))], ["rule", "seconds", "rejected"])
    return run


def plan(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """Rules in the order in which to run them, measured on about ``sample_docs`` texts chosen by hash of the id."""
    total = documents.count()
    share = min(1.0, sample_docs / max(total, 1))
    some = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    found = some.mapInArrow(_measure(list(RULES)), "rule string, seconds double, rejected bigint").groupBy("rule").agg(
        F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()  # a row per rule
    gain = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in found}
    return sorted(RULES, key=lambda name: (-gain.get(name, 0.0), name))


def _apply(order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in X.slices(batch.column("text")):
                s = Statistics(data, offsets)
                failed = base_failed(s)
                by = np.full(s.n_rows, "", object)
                by[failed] = "base"
                left = np.flatnonzero(~failed)
                rest = s.take(left)
                for name in order:
                    if not len(left):
                        break
                    gone = RULES[name](rest)
                    by[left[gone]] = name
                    if gone.any():
                        left, rest = left[~gone], rest.take(np.flatnonzero(~gone))
                kept = np.zeros(s.n_rows, bool)
                kept[left] = True
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), *(X.longs(x) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)),
                     pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    return run


def judge(documents: DataFrame) -> DataFrame:
    """Base counts and verdict for each row of ``documents`` (doc_id, text).

    ``base_failed``: under 50 words, or over half of the words in repeated three-word windows. ``kept``:
    passes that and every rule of ``RULES``. Null and empty texts have no words, so they fail. Rows are
    independent of each other; other columns are ignored; an empty table gives no rows.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = X.with_small_batches(texts)
    return texts.mapInArrow(_apply(plan(texts)), "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                                                 "n_repeat_words bigint, base_failed boolean, kept boolean")


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
spread AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS pos
           FROM (SELECT doc_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM texts)),
byword AS (SELECT doc_id, sum(n)::BIGINT AS n_words, sum(n * length(word))::BIGINT AS word_chars, max(n) AS n_top
           FROM (SELECT doc_id, word, count(*) AS n FROM spread GROUP BY ALL) GROUP BY doc_id),
threes AS (SELECT doc_id, pos, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM spread WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM threes WHERE c IS NOT NULL) WHERE n > 1),
repeated AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, pos + k AS pos FROM twice, (VALUES (0), (1), (2)) t(k)) GROUP BY doc_id),
lines AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM texts)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
byline AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_dup_lines FROM lines GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, coalesce(w.n_words, 0) AS n_words, coalesce(w.word_chars, 0) AS word_chars, coalesce(n_top, 0) AS n_top,
         len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(body, '[A-ZÀ-ÖØ-Þ]')) AS n_upper,
         len(regexp_extract_all(body, '[A-Za-zÀ-ÖØ-öø-ÿ]')) AS n_letters, len(regexp_extract_all(body, '!')) AS n_marks,
         len(regexp_extract_all(body, '[0-9]')) AS n_digits
  FROM texts t LEFT JOIN byword w USING (doc_id) LEFT JOIN byline l USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR word_chars > 25 * n_words OR 5 * n_symbols > 2 * n_words OR 10 * n_dup_lines > 7 * n_lines OR 5 * n_upper > 3 * n_letters
            OR 2 * n_marks > n_words OR 2 * n_digits > word_chars OR 10 * n_top > 4 * n_words) AS kept
FROM judged
"""
