"""Language of a text by prediction with partial matching.

Method: a variable-order context tree of bytes per language. The longest known context predicts the
next byte; where it has not seen that byte, an escape is paid for and the next shorter context
predicts. Statistics are frozen after training, so the code length of a text is a sum over its
positions, and the language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as X

ORDER = 4
#: Bytes on which a language is learnt, about; and on which all are together, where they are many.
SAMPLE_BYTES, ALL_SAMPLES = 2_000_000, 12_000_000
#: Languages whose code lengths lie in one table.
TABLE_LANGUAGES = 16
UNKNOWN = "und"

_FOLD = X.LOWER.copy()
_FOLD[:0x80][~np.isin(np.arange(0x80), np.arange(ord("a"), ord("z") + 1)) & ~np.isin(np.arange(0x80), np.arange(ord("A"), ord("Z") + 1))] = 0x20


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case (ASCII and Latin-1 letters), runs of ASCII bytes that are no letters as one space."""
    out = _FOLD[data]
    if len(out):
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
        out[latin] = data[latin] + 0x20
    space = out == 0x20
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[first] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def contexts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte behind the ``ORDER`` bytes before it, in one integer; zeros stand before a text."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = data.astype(np.int64)
    for back in range(1, ORDER + 1):
        before = np.zeros(len(data), np.int64)
        before[back:] = data[:len(data) - back]
        before[place < back] = 0
        key |= before << (8 * back)
    return key


@dataclass
class Counts:
    """What training gathered: (context and byte, language, times). It is small; workers build the model."""

    keys: np.ndarray
    language: np.ndarray
    counts: np.ndarray
    languages: list[str]


_BUILT: dict[tuple, Languages] = {}


def model_of(counts: Counts) -> Languages:
    """The model, built once per worker."""
    name = (tuple(counts.languages), len(counts.keys), int(counts.counts.sum()), int(counts.keys.sum()))
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Languages(counts)
    return _BUILT[name]


class Languages:
    """Models of a few languages each, side by side."""

    def __init__(self, counts: Counts):
        self.languages, self.models = counts.languages, []
        for first in range(0, len(counts.languages), TABLE_LANGUAGES):
            own = (counts.language >= first) & (counts.language < first + TABLE_LANGUAGES)
            self.models.append(Model(counts.keys[own], counts.language[own] - first, counts.counts[own], counts.languages[first:first + TABLE_LANGUAGES]))

    def code(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([m.code(keys) for m in self.models], axis=1)


class Model:
    """Code lengths in bits of every known (context, byte), for all languages at once.

    An entry of a language that lacks it holds what escaping to shorter contexts costs there.
    """

    def __init__(self, keys: np.ndarray, language: np.ndarray, counts: np.ndarray, languages: list[str]):
        self.languages = languages
        width = len(languages)
        self.pairs, self.bits, self.heads, self.escapes = [], [], [], []
        shorter = np.full((256, width), 8.0)  # no context knows the byte
        for order in range(ORDER + 1):
            mask = (1 << (8 * (order + 1))) - 1
            pair, at = np.unique(keys & mask, return_inverse=True)
            seen = np.zeros((len(pair), width))
            np.add.at(seen, (at, language), counts)
            head, of = np.unique(pair >> 8, return_inverse=True)
            total, kinds = np.zeros((len(head), width)), np.zeros((len(head), width))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(seen / (total + kinds)[of])
            if order:
                below = bits[np.searchsorted(self.pairs[-1].keys, pair & (mask >> 8))]  # noqa: F821
            else:
                below = shorter[pair]
            bits = np.where(seen > 0, own, escape[of] + below)
            self.pairs.append(X.Table(pair))
            self.bits.append(bits)
            self.heads.append(X.Table(head))
            self.escapes.append(escape)

    def code(self, keys: np.ndarray) -> np.ndarray:
        """Bits for each position and language."""
        out = np.zeros((len(keys), len(self.languages)))
        left = np.arange(len(keys))
        for order in range(ORDER, -1, -1):
            mask = (1 << (8 * (order + 1))) - 1
            own = keys[left] & mask
            at = self.pairs[order].find(own)
            hit = at >= 0
            out[left[hit]] += self.bits[order][at[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return out
            head = self.heads[order].find(own >> 8)
            known = head >= 0
            out[left[known]] += self.escapes[order][head[known]]
        out[left] += 8.0
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = np.asarray(batch.column("language"))
        for row, end, data, offsets in X.slices(batch.column("text")):
            data, offsets = fold(data, offsets)
            keys, spoken = contexts(data, offsets), np.repeat(lang[row:end], np.diff(offsets))
            for own in np.unique(spoken):
                found, n = np.unique(keys[spoken == own], return_counts=True)
                yield pa.RecordBatch.from_arrays([X.longs(np.full(len(found), own)), X.longs(found), X.longs(n)], ["language", "key", "n"])


def train(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, all_samples: int = ALL_SAMPLES) -> Counts | None:
    """Counts from ``labelled`` (doc_id, text, lang), or None if no row has a language and a text.

    Every language is learnt from about ``sample_bytes`` bytes of its documents, or from an equal share of
    ``all_samples`` if there are many languages; documents are chosen by hash of the id and taken whole, those
    longer than a tenth of the sample only if the language has no others. All contexts of the sample are kept,
    so totals and escapes are those of the sample and the driver holds at most ``all_samples`` of them, about.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size = F.octet_length("text").cast("long")
    kinds = rows.groupBy("lang").agg(F.count("*").alias("docs")).collect()  # a row per language
    if not kinds:
        return None
    limit = max(1000, min(sample_bytes, all_samples // len(kinds)))
    short, lot = size <= limit // 10, F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sizes = rows.groupBy("lang").agg(F.sum(F.when(short, size)).alias("short"), F.sum(size).alias("bytes"),
                                     F.coalesce(F.min(F.when(short, lot)), F.min(lot)).alias("least")).orderBy("lang").collect()
    languages = [r["lang"] for r in sizes]
    index = rows.sparkSession.createDataFrame(  # a document of each language at least
        [(r["lang"], k, max(r["least"] + 1, int(1e6 * min(1.0, limit / max(1, r["short"] or r["bytes"])))), r["short"] is not None) for k, r in enumerate(sizes)],
        "lang string, language bigint, below bigint, shorts boolean")
    some = rows.join(F.broadcast(index), "lang").filter(lot < F.col("below")).filter(~F.col("shorts") | short)
    counted = (X.with_small_batches(some.select("text", "language")).mapInArrow(_count, "language bigint, key bigint, n bigint")
               .groupBy("language", "key").agg(F.sum("n").alias("n")).toArrow())
    if not len(counted):
        return None
    language, key, n = (np.asarray(counted.column(c).combine_chunks()) for c in ("language", "key", "n"))
    order = np.lexsort((key, language))
    return Counts(key[order], language[order], n[order], languages)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = model_of(model.value) if model is not None else None
        for batch in batches:
            for row, end, data, offsets in X.slices(batch.column("text")):
                held = batch.slice(row, end - row)
                text = [str(x) if (x := s.as_py()) else "" for s in held.column("text")]
                letters = np.array([any(map(str.isalpha, t)) for t in text], bool)
                rows = len(text)
                if learnt is None:
                    name, score = [UNKNOWN] * rows, np.zeros(rows)
                else:
                    bits = np.zeros((rows, len(learnt.languages)))
                    data, offsets = fold(data, offsets)
                    full = np.flatnonzero(np.diff(offsets) > 0)
                    if len(full):
                        keys = contexts(data, offsets)
                        total = np.zeros((rows, bits.shape[1]))
                        owner = np.repeat(np.arange(rows), np.diff(offsets))
                        for at in range(0, len(keys), 1 << 18):
                            code, who = learnt.code(keys[at:at + (1 << 18)]), owner[at:at + (1 << 18)]
                            begin = X.group_starts(who)
                            total[who[begin]] += np.add.reduceat(code, begin)
                        bits = total
                    best = bits.argmin(1)
                    odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000.0))
                    score = np.where(letters, 1.0 / odds.sum(1), 0.0)
                    name = [learnt.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(held.column(i) for i, n in enumerate(held.schema.names)), pa.array(name, pa.string()), pa.array(score, pa.float64())],
                    [*held.schema.names, "lang_pred", "score"])
    return run


def predict(documents: DataFrame, model: Counts | None) -> DataFrame:
    """``documents`` with lang_pred and score, the posterior of that language under equal priors.

    Texts without a letter, empty and null ones give ``und`` with score 0, and so does every text if the
    model is None. Equal code lengths go to the language that sorts first. Columns called lang_pred or
    score are replaced. Rows are independent of each other; an empty table gives no rows.
    """
    documents = documents.drop("lang_pred", "score")
    held = documents.sparkSession.sparkContext.broadcast(model) if model is not None else None
    kind = ", ".join(f"`{n}` {t}" for n, t in documents.dtypes)
    return X.with_small_batches(documents).mapInArrow(_predict(held), kind + ", lang_pred string, score double")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null without id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus
