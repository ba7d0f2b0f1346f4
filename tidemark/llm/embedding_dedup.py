"""Near-duplicate vectors by cosine, and one representative per group.

Method: spherical k-means deals vectors into cells; blocks of a cell are multiplied with each other. Links
across borders are all found: a vector also visits every later cell that could hold a partner. With own
centre a and another one c, a vector y of the other cell has y.c >= y.a, so x.(a - c) <= |x - y| |a - c|;
a vector whose x.(a - c) is larger than sqrt(2 - 2 threshold) |a - c| has no partner there, and only that
is left out. Products in single precision come first; those near the threshold are settled in double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.cluster import join_small, scratch_path, settle
from tidemark.llm import text as X
from tidemark.llm.components import components

#: Vectors on which centres are fitted, and the most centres that gives; beyond, cells grow and are cut into more blocks.
SAMPLE_VECTORS = 50_000
MAX_CELLS = 8192
CELL_VECTORS = 4096
#: Rows of a block of a cell, and of a block of its visitors.
BLOCK, VISITORS = 4096, 16_384


def _usable(dimension: int):
    """Whether each vector can be compared, and a digest of its values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = X.mix(np.arange(1, 2 * dimension + 1, dtype=np.uint64)).reshape(2, -1) | np.uint64(1)
        for batch in batches:
            column = batch.column("embedding")
            values = column.flatten()
            sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
            first = np.cumsum(sizes) - sizes
            right = np.flatnonzero(sizes == dimension)
            block = flat[first[right][:, None] + np.arange(dimension)] + 0.0 if len(right) else np.zeros((0, dimension))
            with np.errstate(over="ignore", invalid="ignore"):
                sound = np.isfinite(block).all(1) & (block != 0).any(1)
            right, block = right[sound], block[sound]
            digest = [(X.mix(block.view(np.uint64)) * w).sum(1, dtype=np.uint64) for w in weights]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(right)), column.take(pa.array(right)), X.longs(digest[0]), X.longs(digest[1])],
                ["vec_id", "embedding", "d1", "d2"])
    return run


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of length one, in double precision; scaled by their largest component first, which no square overflows."""
    block = np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1) + 0.0
    block = block / np.abs(block).max(1, keepdims=True)
    return block / np.sqrt((block * block).sum(1, keepdims=True))


def _cells(centres, threshold: float):
    """Each vector in its own cell, and once in every later cell that may hold a partner of it."""
    reach = np.sqrt(2.0 - 2.0 * threshold) if threshold > -1 else 2.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = centres.value
        rows = max(1, (1 << 21) // len(mine))
        for batch in batches:
            for at in range(0, len(batch), rows):
                held = batch.slice(at, rows)
                near = _unit(held.column("embedding")) @ mine.T
                own = near.argmax(1)
                apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (mine[own] @ mine.T)))
                goes = near[np.arange(len(own)), own][:, None] - near <= reach * apart + 1e-9
                goes &= np.arange(len(mine))[None, :] > own[:, None]
                who, cell = np.nonzero(goes)
                again = held.take(pa.array(np.concatenate([np.arange(len(own)), who])))
                native = np.arange(len(again)) < len(own)
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(np.concatenate([own, cell]), pa.int64()), pa.array(native)],
                                                 [*again.schema.names, "cell", "native"])
    return run


def _multiply(threshold: float):
    """Links of one tile: for each vector how many vectors it links with, and a vector of its group."""
    def run(table: pa.Table) -> pa.Table:
        ids, weight = np.asarray(table.column("vec_id").combine_chunks()), np.asarray(table.column("copies").combine_chunks())
        side = np.asarray(table.column("side").combine_chunks())
        unit = _unit(table.column("embedding").combine_chunks())
        single = unit.astype(np.float32)
        margin = (unit.shape[1] + 4) * 2.0 ** -22  # more than rounding takes off products in single precision
        rows = np.flatnonzero(side != 2)
        whole = (side == 0).all()
        columns = rows if whole else np.flatnonzero(side == 2)
        links, label = np.zeros(len(ids)), np.arange(len(ids))
        step = max(1, (1 << 21) // max(1, len(columns)))
        for at in range(0, len(rows) if len(columns) else 0, step):
            a = rows[at:at + step]
            product = single[a] @ single[columns].T
            linked = product >= threshold + margin
            i, j = np.nonzero(np.abs(product - threshold) < margin)
            for k in range(0, len(i), 1 << 16):
                x, y = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
                linked[x, y] = (unit[a[x]] * unit[columns[y]]).sum(1) >= threshold
            if whole:
                linked &= np.arange(len(columns))[None, :] > np.arange(at, at + len(a))[:, None]
            some = np.flatnonzero(linked.any(1))
            links[a] += linked @ weight[columns]
            links[columns] += weight[a] @ linked
            for k in some:
                mine, found = a[k], label[columns[linked[k]]]
                other = np.unique(found[found != label[mine]])
                if len(other):
                    label[np.isin(label, other)] = label[mine]
        some = np.flatnonzero(links)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label[some], ids[some])
        return pa.table({"vec_id": ids[some], "links": links[some].astype(np.int64), "root": least[label[some]]})
    return run


def centres(vectors: DataFrame, total: int) -> np.ndarray:
    """Unit centres of spherical k-means, fitted on at most about ``SAMPLE_VECTORS`` vectors chosen by hash of the id."""
    share = min(1.0, SAMPLE_VECTORS / max(total, 1))
    some = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share * 1_000_000)
    # the largest component becomes one: squares neither overflow nor vanish
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    some = some.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / top)).alias("features"))
    count = max(2, min(MAX_CELLS, total // CELL_VECTORS))
    fitted = KMeans(k=count, distanceMeasure="cosine", initMode="random", maxIter=8, seed=7).fit(some)
    found = np.array([c for c in fitted.clusterCenters()])
    return found / np.sqrt((found * found).sum(1, keepdims=True))


def near_vectors(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings`` (vec_id, embedding).

    Two vectors link when their cosine in double precision is at least ``threshold``; every such pair is found
    and no other. Null, zero, non-finite vectors, and those of another length than most, link with nothing. Rows
    that share a vec_id are returned each, as one node of the groups; where their vectors differ, the links of
    each add up. Rows without vec_id have no links and a null component. Other columns are ignored; an empty
    table gives no rows.

    Work: each vector is multiplied with its cell and with those later cells that the bound of the method
    admits. In dense tables these are few; where vectors lie in all directions alike, no bound tells cells
    apart and every pair is multiplied once.
    """
    spark = embeddings.sparkSession
    element = embeddings.schema["embedding"].dataType.elementType.simpleString()
    kind = f"array<{element if element in ('float', 'double') else 'double'}>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    common = rows.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    X.limit_batches(spark)
    path = scratch_path(spark, "vectors")
    rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").dropDuplicates().mapInArrow(
        _usable(common["n"]), f"vec_id bigint, embedding {kind}, d1 bigint, d2 bigint").write.parquet(path)
    vectors = spark.read.parquet(path)
    first = vectors.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"))
    path = scratch_path(spark, "representatives")
    vectors.join(first, ["d1", "d2"]).select("vec_id", "rep", "copies", F.when(F.col("vec_id") == F.col("rep"), F.col("embedding")).alias("embedding")).write.parquet(path)
    known = spark.read.parquet(path)
    single = known.filter("embedding IS NOT NULL").select("vec_id", "copies", "embedding")
    total = single.count()
    if not total:
        links = known.select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("root"))
        tiles = links.limit(0)
    else:
        held = spark.sparkContext.broadcast(centres(single, total))
        placed = single.mapInArrow(_cells(held, threshold), f"vec_id bigint, copies bigint, embedding {kind}, cell bigint, native boolean")
        sizes = settle(placed.groupBy("cell").agg(F.ceil(F.count_if("native") / F.lit(BLOCK)).cast("long").alias("blocks"),
                                                  F.ceil(F.count_if(~F.col("native")) / F.lit(VISITORS)).cast("long").alias("more")))
        # a block meets the blocks of its cell once each, and all blocks of visitors; these meet the cell's blocks only
        dealt = join_small(placed, sizes, ["cell"]).withColumn("block", F.expr("pmod(xxhash64(vec_id), CASE WHEN native THEN blocks ELSE more END)"))
        tiled = dealt.withColumn("other", F.explode(F.expr("CASE WHEN blocks = 0 THEN array() WHEN native THEN sequence(0L, blocks + more - 1) ELSE sequence(0L, blocks - 1) END"))).select(
            "vec_id", "copies", "embedding", "cell",
            F.expr("CASE WHEN native THEN least(block, other) ELSE other END").alias("low"),
            F.expr("CASE WHEN native THEN greatest(block, other) ELSE blocks + block END").alias("high"),
            F.expr("CASE WHEN NOT native THEN 1 WHEN block = other THEN 0 WHEN other < block AND other < blocks THEN 1 ELSE 2 END").alias("side"))
        tiles = settle(tiled.groupBy("cell", "low", "high").applyInArrow(_multiply(threshold), "vec_id bigint, links bigint, root bigint"))
    counts = tiles.groupBy("vec_id").agg(F.sum("links").alias("others")).withColumnRenamed("vec_id", "rep")
    edges = tiles.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).union(known.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    roots = components(edges).withColumnsRenamed({"node": "vec_id", "root": "component_id"})
    linked = known.join(counts, "rep", "left").groupBy("vec_id").agg(F.sum(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return (rows.select("vec_id").join(linked, "vec_id", "left").join(roots, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
