"""Nearest neighbours by inner product through a forest of hash prefixes.

Method: in each of several trees a vector has a string of 64 hash bits (signs of random projections), and the
vectors lie in order of that string. A query descends to its place, where its longest-prefix matches lie; the
block around it is scored. The k-th best score so far says how far to ascend: all trees go up together to the
deepest level at which a neighbour of that score would share a prefix with the query in some tree with
probability ``target``, and everything that shares so long a prefix is scored. So the number of candidates
follows the data: few where neighbours are close, all rows where no prefix can tell them apart.

Largest inner products become smallest angles by one more dimension, sqrt(1 - |x|^2 / max |x|^2).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.cluster import join_small, settle
from tidemark.llm import text as X

TREES = 8
BITS = 64
BLOCK = 4096
#: Rows and queries of a tile at most, about.
TILE_ROWS, TILE_QUERIES = 8192, 4096
TARGET = 0.97
_TOP = np.uint64(1 << 63)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1)


def planes(dimension: int, trees: int, seed: int = 11) -> np.ndarray:
    """Directions of all hash bits, tree after tree."""
    return np.random.default_rng(seed).normal(size=(trees * BITS, dimension + 1))


def keys(vectors: np.ndarray, directions: np.ndarray, longest: float, as_query: bool) -> np.ndarray:
    """(row, tree) -> hash string as an unsigned number, first bit on top."""
    norm = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        if as_query:
            wide = np.hstack([vectors / norm, np.zeros_like(norm)])
        else:
            wide = np.hstack([vectors / longest, np.sqrt(np.maximum(0.0, 1.0 - (norm / longest) ** 2))])
    bits = np.nan_to_num(wide) @ directions.T > 0
    return np.packbits(bits.reshape(len(vectors), -1, BITS), axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def _ordered(key: np.ndarray) -> pa.Array:
    """Signed numbers in the order of the unsigned ones."""
    return X.longs(key ^ _TOP)


def _unordered(column: pa.Array) -> np.ndarray:
    return np.asarray(column).view(np.uint64) ^ _TOP


def _hashed(dimension: int, trees: int, longest: float, as_query: bool):
    """Each vector once per tree, with its key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = planes(dimension, trees)
        for batch in batches:
            if not len(batch):
                continue
            found = keys(_matrix(batch.column("embedding")), directions, longest, as_query)
            for tree in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), tree, np.int32)), _ordered(found[:, tree]), *batch.columns],
                                                 ["tree", "key", *batch.schema.names])
    return run


def _best(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the largest ``count`` finite-or-larger scores of each row; -inf is none. All that tie with the last one stay."""
    if scores.shape[1] > count:
        last = -np.partition(-scores, count - 1, axis=1)[:, count - 1:count]
        return np.nonzero((scores >= last) & (scores > -np.inf))
    return np.nonzero(scores > -np.inf)


_PAIRS = "asker bigint, rep bigint, ids array<bigint>, score double"


def _pairs(askers: np.ndarray, rows: pa.Table, scores: np.ndarray, count: int) -> pa.RecordBatch:
    i, j = _best(scores, count)
    held = rows.select(["rep", "ids"]).take(pa.array(j)).combine_chunks()
    return pa.table({"asker": pa.array(askers[i]), "rep": held.column("rep"), "ids": held.column("ids"), "score": pa.array(scores[i, j])})


def _descend(count: int):
    """Blocks of a tree's sorted strings, with the queries that fall into them, to the best pairs of each block."""
    def scored(block: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = np.asarray(block.column("asks").combine_chunks().cast(pa.int8())).astype(bool)
        queries, rows = block.filter(pa.array(asks)), block.filter(pa.array(~asks))
        if len(queries) and len(rows):
            scores = _matrix(queries.column("embedding").combine_chunks()) @ _matrix(rows.column("embedding").combine_chunks()).T
            yield from _pairs(np.asarray(queries.column("rep")), rows, np.nan_to_num(scores, nan=-np.inf), count).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BLOCK:
                yield from by_tree(held)
                held, size = [], 0
        if size:
            yield from by_tree(held)

    def by_tree(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(held)
        tree = np.asarray(block.column("tree").combine_chunks())
        starts = X.group_starts(tree)
        for a, b in zip(starts, np.append(starts[1:], len(tree)), strict=True):
            yield from scored(block.slice(a, b - a))
    return run


def _visits(dimension: int, trees: int, longest: float, depth: int):
    """Each query once per tree and shard that it ascends through; ``level`` 0 goes through all shards of one tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = planes(dimension, trees)
        for batch in batches:
            if not len(batch):
                continue
            level = np.asarray(batch.column("level")).astype(np.int64)
            found = keys(_matrix(batch.column("embedding")), directions, longest, True)
            for tree in range(trees):
                asks = np.flatnonzero(level > 0) if tree else np.arange(len(batch))
                width = np.maximum(depth - level[asks], 0)
                shard = (found[asks, tree] >> np.uint64(BITS - depth)).astype(np.int64) if depth else np.zeros(len(asks), np.int64)
                first, many = (shard >> width) << width, 1 << width
                for at in range(0, len(asks), 256):  # a query of level 0 takes a row per shard
                    part = slice(at, at + 256)
                    again = np.repeat(asks[part], many[part])
                    if len(again):
                        held = batch.take(pa.array(again))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(again), tree, np.int32)), X.longs(X.ramp(first[part], many[part])),
                                                          _ordered(found[again, tree]), *held.columns], ["tree", "shard", "key", *held.schema.names])
    return run


def _ascend(count: int):
    """A tile of rows and queries to the best pairs that share a prefix of the query's level."""
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return pa.table({"asker": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        vectors, key = _matrix(rows.column("embedding").combine_chunks()), _unordered(rows.column("key").combine_chunks())
        asked, asked_key = _matrix(queries.column("embedding").combine_chunks()), _unordered(queries.column("key").combine_chunks())
        level, floor = np.asarray(queries.column("level").combine_chunks()), np.asarray(queries.column("floor").combine_chunks())
        askers, parts = np.asarray(queries.column("rep").combine_chunks()), []
        for at in range(0, len(asked), 256):
            part = slice(at, at + 256)
            scores = np.nan_to_num(asked[part] @ vectors.T, nan=-np.inf)
            apart = (asked_key[part][:, None] ^ key[None, :]) >> (np.uint64(BITS) - np.maximum(level[part], 1).astype(np.uint64))[:, None]
            scores[((apart != 0) & (level[part] > 0)[:, None]) | (scores < floor[part][:, None])] = -np.inf
            parts.append(_pairs(askers[part], rows, scores, count))
        return pa.concat_tables(parts)
    return run


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding, d1, d2), one row per vec_id, of the vectors that take part; and their dimension."""
    element = embeddings.schema["embedding"].dataType.elementType.simpleString()
    kind = element if element in ("float", "double") else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    sound = rows.filter("vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    common = sound.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return sound.withColumns({"d1": F.lit(0).cast("long"), "d2": F.lit(0).cast("long")}), 0
    one = sound.filter(F.size("embedding") == common["n"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return one.withColumns({"d1": F.xxhash64("embedding"), "d2": F.xxhash64(F.lit(1), "embedding")}), common["n"]


def nearest(embeddings: DataFrame, every: int = 20, count: int = 20, trees: int = TREES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``count`` nearest rows of each row whose vec_id ``every`` divides.

    Nearness is the largest inner product, in double precision on the vectors as given; ties go to the smaller
    vec_id, the query itself is left out. A neighbour of the k-th score is found with probability ``target`` or
    more, closer ones with a greater one. Equal vectors are searched once. Null and zero vectors, vectors with
    null or non-finite components, those of another length than most, and rows without vec_id take no part. Rows
    that share a vec_id are one vector, the smallest of them. Other columns are ignored; without queries or
    vectors there are no rows, with fewer vectors than ``count`` all are returned.
    """
    rows, dimension = usable(embeddings)
    kinds = "query_id bigint, rank int, vec_id bigint, score double"
    if not dimension:
        return embeddings.sparkSession.createDataFrame([], kinds)
    rows = X.written(rows)
    take = count + 1  # one of them may be the query
    copies = W.partitionBy("d1", "d2").orderBy("vec_id")  # limited before the shuffle
    ids = rows.select("d1", "d2", "vec_id", F.row_number().over(copies).alias("k")).filter(F.col("k") <= take).groupBy("d1", "d2").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids"))
    flags = rows.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.max(F.col("vec_id") % every == 0).alias("asked"))
    reps = rows.join(flags.join(ids, ["d1", "d2"]).select("rep", "ids", "asked"), F.col("vec_id") == F.col("rep"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    reps = X.written(reps.select("rep", "ids", "asked", "d1", "d2", "embedding", F.sqrt(square).alias("norm")))
    facts = reps.agg(F.count("*").alias("n"), F.max("norm").alias("longest")).first()
    n, longest = facts["n"], facts["longest"]

    X.limit_batches(embeddings.sparkSession)
    element = dict(reps.dtypes)["embedding"]
    kind = f"tree int, key bigint, rep bigint, ids array<bigint>, embedding {element}"
    index = reps.select("rep", "ids", "embedding").mapInArrow(_hashed(dimension, trees, longest, False), kind)
    asking = reps.filter("asked").select("rep", F.array().cast("array<bigint>").alias("ids"), "embedding").mapInArrow(_hashed(dimension, trees, longest, True), kind)
    lying = index.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)))
    lying = lying.repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    close = X.written(lying.mapInArrow(_descend(take), _PAIRS).groupBy("asker", "rep").agg(F.max("score").alias("score"), F.any_value("ids").alias("ids")))

    # as many as a block per tree and query at most
    floors = close.groupBy("asker").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(take - 1)).alias("floor"))
    asked = reps.filter("asked").join(floors, F.col("rep") == F.col("asker"), "left").drop("asker")
    share = 1.0 - (1.0 - target) ** (1.0 / trees)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("floor") / (F.col("norm") * F.lit(float(longest)))))
    chance = F.lit(1.0) - F.acos(cosine) / F.lit(math.pi)
    level = F.when(chance >= 1.0 - 1e-9, BITS).when(chance > 0, F.least(F.lit(BITS), F.floor(F.log(F.lit(share)) / F.log(chance)))).otherwise(0).cast("int")
    level = F.when(F.col("floor").isNull() | F.isnan(cosine), 0).otherwise(F.when(level * 1.0 < math.log2(trees) + 1e-9, 0).otherwise(level))
    asked = X.written(asked.select("rep", level.alias("level"), F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "embedding"))

    depth = max(0, math.ceil(math.log2(max(n, 1) / TILE_ROWS)))
    shard = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), BITS - depth) if depth else F.lit(0).cast("long")
    visits = asked.mapInArrow(_visits(dimension, trees, longest, depth), f"tree int, shard bigint, key bigint, rep bigint, level int, floor double, embedding {element}")
    index = index.withColumn("shard", shard)
    sizes = index.groupBy("tree", "shard").agg(F.ceil(F.count("*") / F.lit(TILE_ROWS)).cast("long").alias("chunks"))
    loads = visits.groupBy("tree", "shard").agg(F.ceil(F.count("*") / F.lit(TILE_QUERIES)).cast("long").alias("blocks"))
    tiles = settle(sizes.join(loads, ["tree", "shard"]))
    dealt = join_small(index, tiles, ["tree", "shard"], salts=1).withColumn("chunk", F.expr("pmod(xxhash64(rep), chunks)")).withColumn(
        "block", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("chunks", "blocks")
    asking = join_small(visits, tiles, ["tree", "shard"], salts=1).withColumn("block", F.expr("pmod(xxhash64(rep), blocks)")).withColumn(
        "chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).drop("chunks", "blocks")
    by = ["tree", "shard", "chunk", "block"]
    far = dealt.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(_ascend(take), _PAIRS)

    pairs = close.unionByName(far).groupBy("asker", "rep").agg(F.max("score").alias("score"), F.any_value("ids").alias("ids"))
    found = pairs.select("asker", F.explode("ids").alias("vec_id"), "score")
    near = W.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    lists = found.withColumn("k", F.row_number().over(near)).filter(F.col("k") <= take).groupBy("asker").agg(
        F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("near"))
    lists = X.written(reps.select("rep", "d1", "d2").join(lists, F.col("rep") == F.col("asker")).select("d1", "d2", "near"))
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "d1", "d2")
    others = F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, count)
    told = join_small(queries, lists, ["d1", "d2"], salts=16)
    return told.select("query_id", F.posexplode(others).alias("at", "s")).selectExpr("query_id", "at + 1 AS rank", "s.vec_id", "s.score")
