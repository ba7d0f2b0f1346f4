"""Documents whose sets of word shingles are similar, and the groups they form.

Method: size-banded tiles with hashed bitmaps. A document's shingle set is cut by hash into as many
parts as its size band may differ by, plus one, so two sets that link hold at least one part in
common. Documents that share a part meet in a tile. Inside a tile bit counts of hashed bitmaps bound
the overlap from above, and pairs that pass are settled by exact intersection of sorted arrays.

Linked sets have one part more in common than there are spare ones. So a set may leave out as many parts, if
all sets choose by one order: small parts go first, then those that hold nothing but shingles which a sample of
the documents shows to be common. Otherwise a common line would chain documents that have nothing else in common.

Only groups are asked for, so a pair whose ends are already joined is not looked at again, and no
pairs are emitted: a tile returns a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.cluster import scratch_path
from tidemark.llm import text as X
from tidemark.llm.components import components

TILE_SHINGLES = 1 << 19
BITS_LIMIT = 1 << 15
DEALS = 12
ROUNDS = 5
#: Documents on which common shingles are counted (a table of many gives one of ``SAMPLE_PART``), how many must hold one, and how
#: many shingles are told to the tasks at most. In a fixed sample a line that chains groups gets rarer as the table grows.
SAMPLE_DOCS, SAMPLE_PART, SAMPLE_HOLDERS, COMMON = 10_000, 20, 3, 200_000


class Similarity:
    """``num / den`` of the union; sizes fall into bands of that ratio."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def links(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (a + b - common)

    def bands(self, largest: int) -> np.ndarray:
        """Smallest size of each band; a size and the largest it can link with lie in bands that touch."""
        lows = [1]
        while lows[-1] <= largest:
            lows.append(lows[-1] * self.den // self.num + 1)
        return np.array(lows, np.int64)

    def parts(self, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parts, spare ones among them, least elements of a part that is used) for documents that meet at each band.

        Linked sets differ by at most a number of elements, so one part more than that makes one equal.
        Spare parts make more of them equal: as many light ones as the spare can then be left out, such
        as a single shingle of a common line.
        """
        top = np.append(lows[1:], lows[-1] * self.den // self.num + 1) - 1
        both = top + top * self.den // self.num
        need = both * (self.den - self.num) // (self.den + self.num) + 1
        least = np.where((lows >= 64) & (2 * lows >= 9 * need), 2, 1)  # where parts are full enough to afford it
        spare = np.ones(len(lows), np.int64)
        for _ in range(12):
            parts = need + spare
            load = lows / parts
            light = parts * np.exp(-load) * np.where(least == 2, 1 + load, 1)
            spare = np.minimum(1 + np.ceil(light + 3 * np.sqrt(light)).astype(np.int64) + need // 8, need)
        spare = np.where(lows < 8, 0, spare)
        return need + spare, spare, least


def shingle_sets(words: X.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, row after row, and how many each has.

    A row of fewer words than ``width`` has its whole sequence as its only shingle.
    """
    hashes = words.hashes()
    starts = words.window_starts(width)
    rows = np.repeat(np.arange(len(words.counts)), np.maximum(words.counts - width + 1, 0))
    names = X.window_hash(hashes, starts, width)
    for size in range(1, width):
        short = np.flatnonzero(words.counts == size)
        names = np.concatenate([names, X.window_hash(hashes, words.first[short], size)])
        rows = np.concatenate([rows, short])
    order = np.lexsort((names, rows))
    names, rows = names[order], rows[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])
    names, rows = names[new], rows[new]
    return names, np.bincount(rows, minlength=len(words.counts))


def _part_names(names: np.ndarray, counts: np.ndarray, sim: Similarity, seed: int = 0, common: X.Table | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names of the parts of all rows at both bands that a row's size touches, with their rows.

    ``common`` are shingles that many documents hold; parts of nothing else are left out where small parts
    have not used up what may be left out. Any set of shingles is right, as long as all rows are given the same.
    """
    if not len(names):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    usual = np.zeros(len(names), bool) if common is None else common.find(names) >= 0
    lows = sim.bands(int(counts.max()))
    parts, spare, least = sim.parts(lows)
    band = np.searchsorted(lows, counts, "right") - 1
    rows = np.repeat(np.arange(len(counts)), counts)
    out, owners = [], []
    for step in (0, 1):  # a row meets larger ones at its own band, smaller ones at the band before
        level = band - step
        todo = (level >= 0) & (counts > 0)
        for deal in range(DEALS):
            # Two sets whose equal parts may all be light both know it, and are dealt anew by another hash.
            k = np.where(todo, parts[np.maximum(level, 0)], 0)
            first = np.cumsum(k) - k
            held = todo[rows]
            r = rows[held]
            x = X.mix(names[held] ^ np.uint64(0x5851F42D4C957F2D * (64 * seed + deal + 1) % 2**64))
            cell = first[r] + ((x >> np.uint64(33)).astype(np.int64) * k[r] >> 31)
            total = np.zeros(int(k.sum()), np.uint64)
            np.add.at(total, cell, X.mix(x + np.uint64(1)))
            owner = np.repeat(np.arange(len(counts)), k)
            slot = np.arange(len(total)) - first[owner]
            tag = X.mix((slot * 64 + deal).astype(np.uint64) * np.uint64(4099) + level[owner].astype(np.uint64))
            light = np.bincount(cell, minlength=len(total)) < least[level[owner]]
            keep = ~light if deal < DEALS - 1 else np.ones(len(total), bool)
            value = X.mix(total ^ tag)
            left = np.where(todo, spare[np.maximum(level, 0)], 0) - np.bincount(owner[light], minlength=len(counts))
            dull = np.flatnonzero(~light & (np.bincount(cell, ~usual[held], minlength=len(total)) == 0) & (left[owner] > 0))
            if len(dull):  # of each row the largest names go first
                dull = dull[np.lexsort((~value[dull], owner[dull]))]
                begin = X.group_starts(owner[dull])
                place = np.arange(len(dull)) - np.repeat(begin, np.diff(np.append(begin, len(dull))))
                keep[dull[place < left[owner[dull]]]] = False
            out.append(value[keep])
            owners.append(owner[keep])
            todo &= left < 0
            if not todo.any():
                break
    return np.concatenate(out), np.concatenate(owners)


def _digests(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set."""
    out = np.zeros((2, len(counts)), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        first = (np.cumsum(counts) - counts)[full]
        for digest, seed in zip(out, (11, 13), strict=True):
            digest[full] = np.add.reduceat(X.mix(names ^ np.uint64(seed)), first)
    return out[0], out[1]


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in X.slices(batch.column("text")):
                names, counts = shingle_sets(X.Words(X.LOWER[data], offsets), width)
                d1, d2 = _digests(names, counts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), X.longs(counts), X.longs(d1), X.longs(d2)], ["doc_id", "n", "d1", "d2"])
    return run


def _count_shingles(width: int):
    """Shingles of the documents of each slice, and how many of them hold each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in X.slices(batch.column("text")):
                names, n = np.unique(shingle_sets(X.Words(X.LOWER[data], offsets), width)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([X.longs(names), X.longs(n)], ["name", "n"])
    return run


def common_shingles(texts: DataFrame, total: int, width: int) -> np.ndarray:
    """Shingles that ``SAMPLE_HOLDERS`` documents of a sample hold, the most common ones; at most ``COMMON``, whatever the table."""
    share = min(1.0, max(SAMPLE_DOCS, total // SAMPLE_PART) / max(total, 1))
    some = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * share) + 1)
    counted = some.mapInArrow(_count_shingles(width), "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") >= SAMPLE_HOLDERS).orderBy(F.desc("n"), "name").limit(COMMON).select("name").toArrow()
    return np.asarray(found.column("name").combine_chunks()).view(np.uint64) if len(found) else np.zeros(0, np.uint64)


def _find_parts(width: int, sim: Similarity, seed: int, common):
    """Parts of every document. Of the documents of a slice that share a part only the first asks for
    it; the others are tied to it at once (``known``), so a common part sends a row per slice at most.
    With a column ``group`` only documents of one group share parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = X.Table(common.value)
        for batch in batches:
            ids, valid = X.int64_column(batch.column("doc_id"))
            for row, end, data, offsets in X.slices(batch.column("text")):
                names, counts = shingle_sets(X.Words(X.LOWER[data], offsets), width)
                own = ids[row:end]
                # equal sets are linked by their digest; only the first of a slice takes part
                d1, d2 = _digests(names, counts)
                order = np.lexsort((own, d2, d1))
                order = order[(counts > 0)[order] & valid[row:end][order]]
                lead = np.zeros(len(own), bool)
                lead[order[X.group_starts(d1[order], d2[order])]] = True
                part, owner = _part_names(names[np.repeat(lead, counts)], np.where(lead, counts, 0), sim, seed, usual)
                if "group" in batch.schema.names:
                    part = X.mix(part ^ X.mix(X.int64_column(batch.column("group"))[0][row:end].view(np.uint64))[owner])
                doc = own[owner]
                order = np.lexsort((doc, part))
                part, doc = part[order], doc[order]
                begin = X.group_starts(part)
                least = np.repeat(doc[begin], np.diff(np.append(begin, len(part))))
                later = doc != least
                near = np.unique(np.stack([doc[later], least[later]], 1), axis=0)
                nothing = pa.nulls(len(near), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([X.longs(part[begin]), nothing]), pa.concat_arrays([X.longs(doc[begin]), X.longs(near[:, 0])]),
                    pa.concat_arrays([pa.nulls(len(begin), pa.int64()), X.longs(near[:, 1])])], ["part", "doc_id", "known"])
    return run


def _arrays(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            for row, end, data, offsets in X.slices(batch.column("text")):
                names, counts = shingle_sets(X.Words(X.LOWER[data], offsets), width)
                held = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*(held.column(i) for i in rest), X.lists_of(X.longs(names), counts)],
                                                 [*(batch.schema.names[i] for i in rest), "shingles"])
    return run


class Forest:
    """Union-find over the rows of a tile."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def link_tile(sets: list[np.ndarray], labels: np.ndarray, across: np.ndarray | None, sim: Similarity) -> list[tuple[int, int]]:
    """Links that join rows of different labels; with ``across`` only between rows it marks and the others.

    Rows go by size, so those that can link are neighbours. Every pair of rows that no path of links
    joins yet is compared: first by bit counts, then, if these allow it, exactly.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    size = size[order]
    if len(order) < 2:
        return []
    width = min(BITS_LIMIT, max(64, 1 << int(4 * size[-1] - 1).bit_length()))
    bits = np.zeros((len(order), width // 64), np.uint64)
    for k, r in enumerate(order):
        at = X.mix(sets[r]) % np.uint64(width)
        np.bitwise_or.at(bits[k], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    forest, side = Forest(labels[order]), None if across is None else across[order]
    links = []
    reach = np.searchsorted(size * sim.num, size * sim.den, "right")
    for i in range(len(order)):
        js = np.arange(i + 1, reach[i])
        js = js[forest.label[js] != forest.label[i]]
        if side is not None:
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        # a bit that only one side sets stands for an element that the other lacks
        lacks = np.bitwise_count(bits[i] & ~bits[js]).sum(1, dtype=np.int64)
        spare = np.bitwise_count(bits[js] & ~bits[i]).sum(1, dtype=np.int64)
        most = np.minimum(size[i] - lacks, size[js] - spare)
        js = js[sim.links(most, size[i], size[js])]
        while len(js):
            j, js = js[0], js[1:]
            mine, other = sets[order[i]], sets[order[j]]
            at = np.searchsorted(other, mine)
            common = int((other[np.minimum(at, len(other) - 1)] == mine).sum())
            if sim.links(common, size[i], size[j]):
                links.append((int(order[i]), int(order[j])))
                forest.join(i, j)
                js = js[forest.label[js] != forest.label[i]]
    return links


def _tile(sim: Similarity):
    """(a, b) for the rows of a tile that links join to a smaller id: b is the smallest they reach."""
    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("doc_id"))
        sets = [np.asarray(s.values).view(np.uint64) for s in table.column("shingles")]
        labels = np.asarray(table.column("label"))
        across = np.asarray(table.column("minor")) if "minor" in table.column_names else None
        forest = Forest(ids)
        for i, j in link_tile(sets, labels, across, sim):
            forest.join(i, j)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, forest.label, ids)
        root = least[forest.label]
        lower = np.unique(ids, return_index=True)[1]  # rows of one id stand together
        lower = lower[root[lower] < ids[lower]]
        return pa.table({"a": ids[lower], "b": root[lower]})
    return run


def _groups(texts: DataFrame, width: int, sim: Similarity, seed: int, common) -> DataFrame:
    """(doc_id, group) of the documents that parts in common connect; what links is in one group."""
    parts = texts.mapInArrow(_find_parts(width, sim, seed, common), "part bigint, doc_id bigint, known bigint")
    met = parts.withColumn("least", F.min("doc_id").over(Window.partitionBy("part", "known")))
    near = met.select(F.col("doc_id").alias("a"), F.coalesce("known", "least").alias("b")).filter("b < a").distinct()
    return components(near).withColumnsRenamed({"node": "doc_id", "root": "group"})


def _members(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents of the groups with the chunks that a group needs and the one a document is dealt to."""
    sized = X.written(groups.join(counts, "doc_id"))
    chunks = sized.groupBy("group").agg(F.ceil(F.sum("n") / F.lit(TILE_SHINGLES)).cast("long").alias("chunks"))
    return X.written(sized.join(chunks, "group").withColumn("chunk", F.expr("pmod(xxhash64(doc_id), chunks)")))


def similar_groups(documents: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``documents`` (doc_id, text).

    Words are lower-cased in ASCII; a document's set holds its distinct ``width``-word shingles, or its
    whole sequence if that is shorter, and is empty without words. Two documents link when
    ``den * common >= num * union``; the component is the smallest doc_id that links reach. Null and
    wordless texts link with nothing. Rows that share a doc_id are one node and are all returned; rows
    without doc_id have a null component. Other columns are ignored; an empty table gives no rows.
    """
    sim = Similarity(num, den)
    texts = X.with_small_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    path = scratch_path(documents.sparkSession, "sets")
    texts.mapInArrow(_describe(width), "doc_id bigint, n bigint, d1 bigint, d2 bigint").write.parquet(path)
    docs = documents.sparkSession.read.parquet(path)
    if not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = X.with_small_batches(X.written(texts.filter("doc_id IS NOT NULL").distinct()))  # counted before the shuffle

    common = documents.sparkSession.sparkContext.broadcast(common_shingles(texts, docs.count(), width))
    groups = _groups(texts, width, sim, 0, common)
    counts = docs.filter("n > 0").groupBy("doc_id").agg(F.max("n").alias("n"))
    members = _members(groups, counts)
    for seed in range(1, ROUNDS):
        # Lines that many documents hold chain large groups. What links also shares a part in any other
        # deal, so large groups are dealt anew until they no longer shrink.
        large = X.written(members.filter("chunks > 1").select("doc_id", "group"))
        before = large.count()
        if not before:
            break
        again = _groups(texts.join(X.few(large), "doc_id"), width, sim, seed, common)
        members = X.written(members.filter("chunks = 1").unionByName(_members(again, counts)))
        if members.filter("chunks > 1").count() > 0.9 * before:
            break

    # tiles: a group of moderate size is one, a larger one is dealt by hash
    arrays = lambda ids: texts.join(X.few(ids), "doc_id").mapInArrow(
        _arrays(width), ", ".join(f"`{n}` {t}" for n, t in ids.dtypes) + ", shingles array<bigint>")
    first = X.written(arrays(members.select("doc_id", "group", "chunk", F.col("doc_id").alias("label")))
                   .groupBy("group", "chunk").applyInArrow(_tile(sim), "a bigint, b bigint"))
    roots = _over_chunks(arrays, members.filter("chunks > 1"), first, sim)

    # equal sets stand with the smallest id of their digest
    same = docs.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    return (docs.join(same, ["d1", "d2"], "left").join(roots.withColumnsRenamed({"a": "rep", "b": "root"}), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("root", F.when(F.col("n") > 0, F.col("rep")), "doc_id")).alias("component_id")))


def _over_chunks(arrays, members: DataFrame, first: DataFrame, sim: Similarity) -> DataFrame:
    """(a, b) as in ``first``, with the links between the chunks of large groups.

    A group of one chunk is done. After the first tiles most of a dense group is one component. Its pairs need no further look, so
    only the other documents travel to every chunk of their group, in blocks of a tile's size.
    """
    if members.isEmpty():
        return first
    ids = X.written(members.select(F.col("doc_id").alias("a")))
    large, done = first.join(X.few(ids), "a", "left_semi"), first.join(X.few(ids), "a", "left_anti")
    roots = components(large).withColumnRenamed("node", "doc_id")
    labelled = X.written(members.join(roots, "doc_id", "left").select(
        "doc_id", "group", "chunk", "chunks", "n", F.coalesce("root", "doc_id").alias("label")))
    main = (labelled.groupBy("group", "label").count().groupBy("group")
            .agg(F.max_by("label", F.struct("count", F.negative("label"))).alias("main")))
    held = labelled.join(main, "group").withColumn("minor", F.col("label") != F.col("main"))
    blocks = held.filter("minor").groupBy("group").agg(F.ceil(F.sum("n") / F.lit(TILE_SHINGLES)).cast("long").alias("blocks"))
    held = held.join(blocks, "group").withColumn("block", F.expr("pmod(xxhash64(doc_id, 1L), blocks)"))
    stay = held.selectExpr("doc_id", "group", "label", "false AS minor", "chunk", "explode(sequence(0L, blocks - 1)) AS block")
    go = held.filter("minor").selectExpr("doc_id", "group", "label", "minor", "explode(sequence(0L, chunks - 1)) AS chunk", "block")
    tiles = arrays(X.written(held.select("doc_id").distinct())).join(stay.union(go), "doc_id")
    between = X.written(tiles.groupBy("group", "chunk", "block").applyInArrow(_tile(sim), "a bigint, b bigint"))
    merged = components(large.union(between)).filter("node <> root")
    return done.union(merged.selectExpr("node AS a", "root AS b"))
