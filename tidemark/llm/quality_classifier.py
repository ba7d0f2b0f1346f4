"""Score texts for quality by a sparse ensemble of rules.

Method: rule ensemble. Shallow trees over statistics of the texts are grown; every path from a root is
a conjunction of thresholds, and so a rule. A lasso logistic regression over the rules leaves few
weights, and these are compiled into one Spark column expression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.cluster import settle
from tidemark.llm import text as X
from tidemark.llm.statistics import Statistics

SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO = 16, 3, 0.002

FEATURES = ("log_words", "word_length", "symbols", "upper", "marks", "bars", "dup_lines", "repeats", "distinct", "top_word", "digits", "line_words", "commas", "stops")


def _features(s: Statistics) -> list[np.ndarray]:
    words = np.maximum(s.n_words, 1)
    chars = np.maximum(s.word_chars, 1)
    return [np.log1p(s.n_words), s.word_chars / words, s.n_symbols / words, s.n_upper / np.maximum(s.n_letters, 1), s.n_of("!") / words, s.n_of("|") / words,
            s.n_dup_lines / np.maximum(s.n_lines, 1), s.n_repeat_words / words, s.n_distinct_words / words, s.n_top_word / words, s.n_digits / chars,
            s.n_words / np.maximum(s.n_lines, 1), s.n_of(",") / words, s.n_of(".") / words]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in X.slices(batch.column("text")):
            figures = _features(Statistics(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), *(pa.array(x, pa.float64()) for x in figures)], ["doc_id", *FEATURES])


def describe(documents: DataFrame) -> DataFrame:
    """(doc_id, the figures of ``FEATURES``) for each row of ``documents`` (doc_id, text); null texts are empty."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return X.with_small_batches(texts).mapInArrow(_describe, "doc_id bigint, " + ", ".join(f"{n} double" for n in FEATURES))


Rule = tuple[tuple[int, bool, float], ...]  # (feature, whether above, threshold) of every condition


def tree_rules(printed: str) -> list[Rule]:
    """Every path from the root to a node, from Spark's printed form of a tree ensemble."""
    found, path = [], []
    for line in printed.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if line.lstrip().startswith("Tree"):
            path = []
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (int(m[3]), m[4] == ">", float(m[5])))]
        found.append(tuple(sorted(c for _, c in path)))
    return list(dict.fromkeys(found))


def compile_rule(rule: Rule) -> Column:
    out = F.lit(True)
    for feature, above, threshold in rule:
        column = F.col(FEATURES[feature])
        out = out & ((column > threshold) if above else (column <= threshold))
    return out


@dataclass
class Ensemble:
    """Weighted rules. Without both labels in the sample there are none and every score is ``prior``."""

    prior: float = 0.5
    intercept: float = 0.0
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        if not self.weights:
            return F.lit(float(self.prior if self.intercept == 0.0 else 1 / (1 + math.exp(-self.intercept))))
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(compile_rule(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(described: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> Ensemble:
    """Ensemble from ``labels`` (doc_id, label 0 or 1).

    At most about ``sample_rows`` labelled rows, chosen by hash of the id, are learnt from. Null labels
    are ignored; of several labels of an id the highest counts.
    """
    known = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    total = known.count()
    share = min(1.0, sample_rows / max(total, 1))
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = settle(described.join(some, "doc_id").select("label", *FEATURES))
    size, mean = rows.agg(F.count("*"), F.avg("label")).first()
    if not size or mean in (0.0, 1.0):
        return Ensemble(prior=0.5 if not size else mean)
    vectors = rows.select("label", array_to_vector(F.array(*FEATURES)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5", subsamplingRate=0.7, seed=seed).fit(vectors)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return Ensemble(prior=mean)
    held = rows.select("label", array_to_vector(F.array(*(compile_rule(r).cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(settle(held))
    weights = {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w}
    return Ensemble(prior=mean, intercept=float(lasso.intercept), weights=weights)
