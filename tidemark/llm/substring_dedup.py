"""Remove passages that a document with a smaller id holds too.

Method: recompression. Words are symbols; one round names runs of equal symbols, the next rounds split
the symbols into left and right ones by hash and name every left-right pair. A name is a fingerprint
of what it stands for, so every executor gives equal substrings equal names, apart from symbols at
their ends. What is left inside a window of words after all rounds depends on the window alone: its
longest symbol there is the window's anchor. A Spark round finds the anchors that several documents
hold; only windows around them are named as a whole, and a second round verifies these.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.cluster import scratch_path, settle
from tidemark.llm import text as X

PAIR_ROUNDS = 3


def _compress(names: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int):
    """Levels of recompression with what each window surely holds of them.

    Yields (names, first word and end word of each symbol, lo, hi): symbols lo..hi of a window follow
    from its words alone; lo > hi means none.
    """
    begin, stop = np.arange(len(names)), np.arange(len(names)) + 1
    # runs: the outermost ones may go on outside the window
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])
    index = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(names)))
    names = np.where(length > 1, X.mix(names[at] ^ X.mix(length.astype(np.uint64))), names[at])
    rows, begin, stop = rows[at], begin[at], begin[at] + length
    lo, hi = index[lo] + 1, index[hi] - 1
    yield names, begin, stop, lo, hi
    for level in range(1, rounds + 1):
        left = (X.mix(names + np.uint64(level)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(names), bool)  # symbol and its successor become one
        pair[:-1] = left[:-1] & ~left[1:] & (rows[1:] == rows[:-1])
        tail = np.zeros(len(names), bool)
        tail[1:] = pair[:-1]
        index = np.cumsum(~tail) - 1
        at = np.flatnonzero(~tail)
        both = pair[at]
        follower = names[np.minimum(at + 1, len(names) - 1)]
        named = X.mix(names[at] * np.uint64(3) + X.mix(follower + np.uint64(level)))
        alive = lo <= hi
        low, high = np.minimum(lo, len(names) - 1), np.maximum(hi, 0)
        lo = lo + (alive & ~left[low])   # may be joined to what stands before the window
        hi = hi - (alive & left[high])   # or to what stands behind it
        dead = lo > hi
        lo = np.where(dead, 1, index[np.minimum(lo, len(names) - 1)])
        hi = np.where(dead, 0, index[np.maximum(hi, 0)])
        names = np.where(both, named, names[at])
        rows, begin, stop = rows[at], begin[at], stop[np.minimum(at + both, len(stop) - 1)]
        yield names, begin, stop, lo, hi


def anchors(hashes: np.ndarray, rows: np.ndarray, starts: np.ndarray, width: int, rounds: int = PAIR_ROUNDS) -> np.ndarray:
    """Anchor of each window: the longest symbol at the last level where the window holds any.

    A window without one (one or two runs of a word) is its own anchor. Equal windows have equal anchors.
    """
    best = np.empty(len(starts), np.uint64)
    levels = _compress(hashes, rows, starts, starts + width - 1, rounds) if len(starts) else iter(())
    held, level = np.ones(len(starts), bool), None  # windows that held a symbol so far, and the level before
    for after in itertools.chain(levels, [None]):
        still = after[3] <= after[4] if after else np.zeros(len(starts), bool)
        last = np.flatnonzero(held & ~still)
        best[last] = _longest(*level, last) if level else X.window_hash(hashes, starts[last], width, 1)
        held, level = still, after
    return best


def _longest(names: np.ndarray, begin: np.ndarray, stop: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Name of the longest symbol of each of these windows; of equally long ones the one of the greatest name."""
    rank = (np.minimum(stop - begin, 255).astype(np.uint64) << np.uint64(56)) | (names >> np.uint64(8))
    lo, hi = lo[which], hi[which]
    top, pick = np.zeros(len(which), np.uint64), lo
    for k in range(int((hi - lo).max(initial=-1)) + 1):
        at = np.minimum(lo + k, hi)
        pick = np.where(rank[at] > top, at, pick)
        top = np.maximum(top, rank[at])
    return names[pick]


def _keep_lowest(keys: tuple[np.ndarray, ...], doc: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (keys, doc, row), and for each place in that order the lowest doc of its key."""
    order = np.lexsort((row, doc, *reversed(keys)))
    begin = X.group_starts(*(k[order] for k in keys))
    ordered = doc[order]
    return order, np.repeat(ordered[begin], np.diff(np.append(begin, len(ordered))))


def _find_anchors(width: int):
    """Anchors of every document. Within a slice one document asks for a name; if another document of
    the slice holds it too, the answer is known, so a common passage sends a row per slice at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, valid = X.int64_column(batch.column("doc_id"))
            for row, end, data, offsets in X.slices(batch.column("text")):
                words = X.Words(data, offsets)
                own, ok = ids[row:end], valid[row:end]
                starts = words.window_starts(width)
                rows = words.rows()
                hashes = words.hashes()
                found = anchors(hashes, rows, starts, width)
                owner = rows[starts]
                step = np.ones(len(starts), bool)  # neighbours mostly share an anchor
                step[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
                step &= ok[owner]
                name, who = X.distinct_pairs(found[step], own[owner[step]])
                begin = X.group_starts(name)
                many = np.repeat(np.diff(np.append(begin, len(name))) > 1, np.diff(np.append(begin, len(name))))
                yield _rows(pa.RecordBatch.from_arrays([X.longs(name[begin]), X.longs(who[begin])], ["name", "doc_id"]),
                            pa.RecordBatch.from_arrays([X.longs(name[many]), X.longs(who[many])], ["name", "doc_id"]))
    return run


def _rows(asks: pa.RecordBatch, known: pa.RecordBatch) -> pa.RecordBatch:
    """Both kinds below each other. ``known`` is null for what asks, else the document: so it is dealt
    apart from what asks under its name and no name draws all its documents into one task."""
    table = pa.Table.from_batches([asks.append_column("known", pa.nulls(len(asks), pa.int64())),
                                   known.append_column("known", known.column("doc_id"))])
    return table.combine_chunks().to_batches()[0] if len(table) else asks.append_column("known", pa.nulls(0, pa.int64()))


def _shas(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """SHA-256 of each row's bytes."""
    view = memoryview(data)
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in itertools.pairwise(offsets.tolist())], pa.string())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each row, and the digest of the row as it is when nothing goes."""
    for batch in batches:
        for row, end, data, offsets in X.slices(batch.column("text")):
            words = X.Words(data, offsets)
            held = batch.slice(row, end - row)
            yield pa.RecordBatch.from_arrays([held.column("row"), held.column("doc_id"), X.longs(words.counts), _shas(*words.joined())],
                                             ["row", "doc_id", "n_words", "full_sha256"])


def _name_windows(width: int):
    """Names of the windows whose anchor is shared, from documents with the list of their shared anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _ = X.int64_column(batch.column("doc_id"))
            keys, _ = X.int64_column(batch.column("row"))
            texts, lists = batch.column("text"), batch.column("names")
            if texts.null_count:
                texts = texts.fill_null("")
            for row, end, data, offsets in X.slices(texts):
                words = X.Words(data, offsets)
                starts, rows = words.window_starts(width), words.rows()
                hashes = words.hashes()
                owner = rows[starts]
                part = lists.slice(row, end - row)
                shared = X.mix(np.asarray(part.flatten()).view(np.uint64)) + X.mix(
                    np.repeat(np.arange(end - row), np.asarray(part.value_lengths())).astype(np.uint64))
                mine = X.mix(anchors(hashes, rows, starts, width)) + X.mix(owner.astype(np.uint64))
                pick = np.flatnonzero(np.isin(mine, shared))
                starts, owner = starts[pick], owner[pick]
                h1 = X.signed(X.window_hash(hashes, starts, width, 0))
                h2 = (X.window_hash(hashes, starts, width, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                doc, key, at = ids[row:end][owner], keys[row:end][owner], (starts - words.first[owner]).astype(np.int32)
                order, least = _keep_lowest((h1, h2), doc, key)
                once = np.zeros(len(order), bool)  # a row that repeats a window sends its first place only
                once[X.group_starts(h1[order], h2[order], doc[order], key[order])] = True
                order, least = order[once], least[once]
                ask = order[doc[order] == least]
                known = order[doc[order] > least]
                named = lambda at_rows: pa.RecordBatch.from_arrays([
                    X.longs(h1[at_rows]), pa.array(h2[at_rows], pa.int32()), X.longs(doc[at_rows]), X.longs(key[at_rows]), pa.array(at[at_rows], pa.int32())],
                    ["h1", "h2", "doc_id", "row", "at"])
                yield _rows(named(ask), named(known))
    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in X.slices(batch.column("text")):
                words = X.Words(data, offsets)
                part = batch.column("places").slice(row, end - row)
                places = np.asarray(part.flatten()).astype(np.int64) + np.repeat(words.first[:-1], np.asarray(part.value_lengths()))
                # a place stands for all windows of its document that are equal to the one there
                starts, rows = words.window_starts(width), X.mix(words.rows().astype(np.uint64))
                names = X.window_hash(words.hashes(), starts, width) ^ rows[starts]
                named = np.zeros(len(words), bool)
                named[places] = True
                places = starts[np.isin(names, names[named[starts]])]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, places, 1)
                np.add.at(edge, places + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                kept, where = words.joined(~gone)
                texts = pa.StringArray.from_buffers(len(where) - 1, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(kept))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, end - row), X.longs(removed), texts, _shas(kept, where)],
                                                 ["row", "n_removed", "kept", "cut_sha256"])
    return run


def repeated_passages(documents: DataFrame, width: int = 13, row: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of ``documents`` (doc_id, text).

    Words are as in ``text``; a word goes if it lies in a window of ``width`` words whose sequence also
    starts in a document with a smaller id, judged on the input. ``kept`` is the rest joined by single
    spaces where something was removed, else null: the text then stays as it is. Null, empty and
    shorter texts lose nothing. Rows of one doc_id are one document as sources, so they take nothing from
    each other; each is cut by its own text, and there is a row of the result for each of them. Rows
    without doc_id lose nothing and are no source. Other columns are ignored; an empty table gives no rows.

    ``row`` names a column of integers that differ from row to row; it is returned too. Without it doc_id
    serves, or numbers given to the rows of a written copy if ids repeat.
    """
    spark = documents.sparkSession
    texts = documents.select((F.col(row) if row else F.col("doc_id")).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                             F.col("text").cast("string").alias("text"))
    if row is None and not texts.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = X.written(texts.withColumn("row", F.monotonically_increasing_id()))
    texts = X.with_small_batches(texts)
    # whole copies: the smallest id stands for all
    marked = texts.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("row", "doc_id", F.unhex(F.md5("text")).alias("digest"))
    first = marked.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.max("doc_id").alias("last")).filter("first.doc_id < last")
    copies = settle(marked.join(first, "digest").filter("doc_id > first.doc_id").select("row", "doc_id", F.col("first.row").alias("first")))
    single = texts.join(X.few(copies.select("row")), "row", "left_anti").select("row", "doc_id", "text")

    docs = X.written(single.mapInArrow(_digests, "row bigint, doc_id bigint, n_words bigint, full_sha256 string"))  # two branches read it

    named = single.select("doc_id", "text").mapInArrow(_find_anchors(width), "name bigint, doc_id bigint, known bigint")
    several = F.count("*").over(Window.partitionBy("name", "known")) > 1
    names = named.withColumn("several", several).filter("several OR known IS NOT NULL")
    lists = names.groupBy("doc_id").agg(F.collect_set("name").alias("names"))

    windows = single.join(lists, "doc_id").mapInArrow(_name_windows(width), "h1 bigint, h2 int, doc_id bigint, row bigint, at int, known bigint")
    least = F.min("doc_id").over(Window.partitionBy("h1", "h2", "known"))
    later = windows.withColumn("least", least).filter("least < doc_id OR known IS NOT NULL")
    path = scratch_path(spark, "places")
    later.groupBy("row").agg(F.collect_set("at").alias("places")).write.parquet(path)
    places = spark.read.parquet(path)
    cut = (single.join(X.few(places.select("row")), "row", "left_semi").join(places, "row").select("row", "text", "places")
           .mapInArrow(_cut(width), "row bigint, n_removed bigint, kept string, cut_sha256 string"))

    done = docs.join(cut, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("cut_sha256", "full_sha256").alias("kept_sha256"), "kept")
    whole = F.col("n_words") >= width
    copied = copies.join(docs.select(F.col("row").alias("first"), "n_words", F.col("full_sha256").alias("sha")), "first").select(
        "row", "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"), F.when(whole, F.lit("")).alias("kept"))
    both = done.unionByName(copied)
    return both.withColumnRenamed("row", row) if row else both.drop("row")
