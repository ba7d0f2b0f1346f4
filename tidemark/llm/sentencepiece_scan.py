"""Encode texts to the pieces of a SentencePiece vocabulary of the greatest total score, and decode them.

Method: max-plus parallel scan. The best segmentation is a longest path. A giant text is cut into
chunks anywhere; a chunk's transfer matrix holds, for each place at its front where a piece may begin
and each place behind its end where one may stop, the best score between them. Matrices are combined
by the associative max-plus product, blocks first, then within blocks; this gives the best scores at every
chunk's front. From these a chunk tells, for each place where it may be left, where it is then entered; these
maps are composed in the same way from the end on, and each chunk is then traced back on its own. Of equal
scores the longer last piece counts everywhere, so chunks never show.

Spaces stand for the word mark. Distinct stretches between safe places (no piece crosses them) are
solved together, a byte position at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.cluster import scratch_path
from tidemark.llm import text as X

GIANT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 15
BLOCK_CHUNKS = 64
UNKNOWN_PENALTY = 10.0
LONG_STRETCH = 256
_NONE = -np.inf
_FRONT = np.zeros(1)


class Pieces:
    """Vocabulary with scores, as a trie over bytes.

    A character that no piece of its own covers costs the lowest score less ``UNKNOWN_PENALTY`` and
    becomes its byte pieces, or the unknown piece if the vocabulary has no byte pieces.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.unknown = model.unk_id()
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.bytes = np.array([byte_ids.get(b, -1) for b in range(256)], np.int64)
        self.text = [b"" if special[i] else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
                     else model.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        self.lengths = np.array([len(t) for t in self.text], np.int64)
        usable = [i for i in range(size) if not special[i] and not model.is_byte(i)]
        score = {i: model.get_score(i) for i in usable}
        self.unknown_score = min(score.values()) - UNKNOWN_PENALTY
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for i in usable:
            node = 0
            for byte in self.text[i]:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ids.append(-1)
                node = children[node][byte]
            ids[node] = i
        self.children, self.ids = children, np.array(ids, np.int64)
        self.scores = np.array([score.get(i, _NONE) for i in ids])
        self.longest = max(4, max(self.lengths[usable]))
        edges = [(node << 8 | byte, child) for node, own in enumerate(children) for byte, child in own.items()]
        self.edges, self.ends = X.Table(np.array([e for e, _ in edges], np.int64)), np.array([c for _, c in edges], np.int64)
        inner = {b for i in usable if len(self.text[i]) > 1 for b in self.text[i]}
        self.alone = np.zeros(256, bool)  # ASCII bytes that stand in no longer piece
        self.alone[[b for b in range(128) if b not in inner]] = True
        self.splits = not any(b" " in self.text[i].lstrip(b" ") for i in usable)

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Safe places: starts of rows, of runs of spaces, and both sides of bytes that stand alone."""
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if self.splits and len(data):
            space = data == 0x20
            cut[1:-1] |= space[1:] & ~space[:-1]
            alone = self.alone[data]
            cut[:-1] |= alone
            cut[1:] |= alone
        return np.flatnonzero(cut[:-1])

    @staticmethod
    def width(lead: np.ndarray) -> np.ndarray:
        """Bytes of the character that a byte leads; 0 inside a character."""
        return np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0], [1, 0, 2, 3], 4)

    def paths(self, data: np.ndarray, start: int, stop: int, limit: int, front: np.ndarray = _FRONT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best scores from ``start`` to every place up to ``limit``, with the last piece and where it begins.

        Only places before ``stop`` begin pieces. ``front`` are the scores with which the first places are entered.
        """
        n = limit - start
        best, last, back = np.full(n + 1, _NONE), np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        best[:len(front)] = front[:n + 1]
        raw = data[start:limit].tobytes()
        for at in range(min(stop - start, n)):
            own = best[at]
            if own == _NONE:
                continue
            size = int(self.width(np.array([raw[at]]))[0])
            node, single = 0, False
            for k in range(at, n):
                node = self.children[node].get(raw[k], -1)
                if node < 0:
                    break
                if self.ids[node] >= 0:
                    single |= k + 1 - at == size
                    if own + self.scores[node] > best[k + 1]:
                        best[k + 1], last[k + 1], back[k + 1] = own + self.scores[node], self.ids[node], at
            if not single and at + size <= n and own + self.unknown_score > best[at + size]:
                best[at + size], last[at + size], back[at + size] = own + self.unknown_score, -1, at
        return best, last, back

    def solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each stretch, its ids in a row, how many). Equal scores go to the longer last piece."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        begin, length = starts[order], size[order]
        base = np.cumsum(length + 1) - (length + 1)
        best = np.full(int((length + 1).sum()), _NONE)
        last, back = np.full(len(best), -1, np.int32), np.zeros(len(best), np.int32)
        best[base] = 0.0
        long = int((length > LONG_STRETCH).sum())
        for k in range(long):
            b, p, w = self.paths(data, int(begin[k]), int(begin[k] + length[k]), int(begin[k] + length[k]))
            span = slice(base[k], base[k] + length[k] + 1)
            best[span], last[span], back[span] = b, p, np.arange(len(w)) - w
        for at in range(int(length[long:].max(initial=0))):
            n = int(np.searchsorted(-length, -at, "left"))
            live = np.arange(long, n)
            own = best[base[live] + at]
            live, own = live[own > _NONE], own[own > _NONE]
            wide = self.width(data[begin[live] + at])
            single = np.zeros(len(live), bool)
            node, todo, k = np.zeros(len(live), np.int64), np.arange(len(live)), 0
            while len(todo):
                todo = todo[at + k < length[live[todo]]]
                edge = self.edges.find(node[todo] << 8 | data[begin[live[todo]] + at + k].astype(np.int64))
                todo, edge = todo[edge >= 0], edge[edge >= 0]
                node[todo] = self.ends[edge]
                k += 1
                whole = todo[self.ids[node[todo]] >= 0]
                single[whole[wide[whole] == k]] = True
                self._offer(best, last, back, base[live[whole]] + at + k, own[whole] + self.scores[node[whole]], self.ids[node[whole]], k)
            rest = np.flatnonzero(~single)
            self._offer(best, last, back, base[live[rest]] + at + wide[rest], own[rest] + self.unknown_score, -1, wide[rest])
        return self._trace(data, order, begin, length, base, best, last, back)

    @staticmethod
    def _offer(best, last, back, at, score, piece, step) -> None:
        better = score > best[at]
        at = at[better]
        best[at] = score[better]
        last[at] = piece[better] if isinstance(piece, np.ndarray) else piece
        back[at] = step[better] if isinstance(step, np.ndarray) else step

    def _trace(self, data, order, begin, length, base, best, last, back):
        """Ids from the last piece to the first, all stretches together, then put in order."""
        stretch, places, found = [], [], []
        at = length.copy()
        live = np.flatnonzero(at > 0)
        while len(live):
            here = base[live] + at[live]
            step = back[here]
            at[live] -= step
            piece = last[here].astype(np.int64)
            known = piece >= 0
            stretch.append(live[known]), places.append(at[live[known]]), found.append(piece[known])
            for k in range(4):  # an unknown character: one id per byte, or the unknown piece
                some = live[~known & (step > k)]
                if self.bytes[0] < 0 and k:
                    break
                byte = self.bytes[data[begin[some] + at[some] + k]]
                stretch.append(some), places.append(at[some] + k), found.append(np.where(byte >= 0, byte, self.unknown))
            live = live[at[live] > 0]
        if not stretch:
            return best[base + length][np.argsort(order)], np.zeros(0, np.int64), np.zeros(len(order), np.int64)
        stretch, places, found = (np.concatenate(x) for x in (stretch, places, found))
        stretch = order[stretch]
        sort = np.lexsort((places, stretch))
        scores = np.empty(len(order))
        scores[order] = best[base + length]
        return scores, found[sort], np.bincount(stretch, minlength=len(order))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, how many each row has, score of each row)."""
        starts = self.stretches(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        first = np.searchsorted(starts, offsets)
        words = X.Words.__new__(X.Words)
        words.data, words.starts, words.ends = data, starts, ends
        _, lead, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        scores, ids, counts = self.solve(data, starts[lead], ends[lead])
        begin = np.cumsum(counts) - counts
        ids = ids[X.ramp(begin[which], counts[which])]
        total = np.concatenate([[0], np.cumsum(counts[which])])
        score = np.concatenate([[0.0], np.cumsum(scores[which])]) if len(which) else np.zeros(1)
        return ids, np.diff(total[first]), np.diff(score[first])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, with the space before the first word; unknown pieces are dropped."""
        return b"".join([self.text[i] for i in ids.tolist()])

    def transfer(self, data: np.ndarray, stop: int) -> np.ndarray:
        """Best scores from the first places of a chunk to the first places at and behind ``stop``."""
        size = self.longest
        out = np.full((size, size), _NONE)
        safe = self.stretches(data, np.array([0, len(data)]))
        safe = safe[safe > 0]
        near, far = safe[safe <= stop], safe
        if not len(near):  # no safe place: a path for each place of entry
            for s in range(min(size, stop + 1)):
                best, _, _ = self.paths(data, s, stop, len(data))
                tail = best[stop - s:stop - s + size]
                out[s, :len(tail)] = tail
            return out
        q1, q2 = int(near[0]), int(near[-1])
        _, _, middle = self.encode(data[q1:q2], np.array([0, q2 - q1])) if q2 > q1 else (None, None, np.zeros(1))
        limit = int(far[far > q2][0]) if (far > q2).any() else len(data)
        tail, _, _ = self.paths(data, q2, stop, limit)
        tail = tail[stop - q2:stop - q2 + size]
        for s in range(min(size, q1 + 1)):
            head, _, _ = self.paths(data, s, q1, q1)
            out[s, :len(tail)] = head[q1 - s] + middle[0] + tail
        return out


    def entries(self, data: np.ndarray, stop: int, front: np.ndarray) -> np.ndarray:
        """For each place at and behind ``stop`` the place where the best path to it enters the chunk; -1 if there is none."""
        safe = self.stretches(data, np.array([0, len(data)]))
        near = safe[(safe > 0) & (safe <= stop)]
        until = int(near[0]) if len(near) else stop
        _, _, back = self.paths(data, 0, until, until if len(near) else len(data), front)
        origin = np.arange(len(back))
        for at in np.flatnonzero(back >= 0):
            origin[at] = origin[back[at]]
        origin[(back < 0) & (np.arange(len(back)) >= len(front))] = -1
        if len(near):  # every path goes through a safe place
            return np.full(self.longest, origin[until])
        tail = origin[stop:stop + self.longest]
        return np.append(tail, np.full(self.longest - len(tail), -1))


_LOADED: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The vocabulary, once per worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Max-plus product by halves."""
    while len(matrices) > 1:
        pairs = [np.max(a[:, :, None] + b[None, :, :], axis=1) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[len(pairs) * 2:]
    return matrices[0]


def fronts(matrices: list[np.ndarray], front: np.ndarray) -> list[np.ndarray]:
    """Best scores before each matrix, from those before the first."""
    out = [front]
    for m in matrices[:-1]:
        out.append(np.max(out[-1][:, None] + m, axis=0))
    return out


def turns(maps: list[np.ndarray], leave: int) -> list[int]:
    """Places between the chunks, first to last, if the last chunk is left at ``leave``."""
    path = [leave]
    for m in reversed(maps):
        path.append(int(m[path[-1]]))
    return path[::-1]


def normalised(column: pa.Array) -> pa.Array:
    """Texts as the vocabulary sees them: a space before the first word; the word mark itself reads as a space."""
    column = column.fill_null("")
    column = pc.replace_substring(column, "▁", " ")
    return pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise("", column, " "))


ENCODED = "doc_id bigint, giant bigint, part bigint, place bigint, n_bytes bigint, ids array<int>, decoded boolean"


def _emit(vocabulary: Pieces, doc_id: pa.Array, giant: pa.Array, part: pa.Array, place: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    ids, counts, _ = vocabulary.encode(data, offsets)
    edge = np.concatenate([[0], np.cumsum(counts)])
    same = [vocabulary.decode(ids[a:b]) == data[o:p].tobytes() for a, b, o, p in zip(edge, edge[1:], offsets, offsets[1:], strict=False)]
    return pa.RecordBatch.from_arrays([doc_id, giant, part, place, X.longs(np.diff(offsets)), X.lists_of(pa.array(ids.astype(np.int32), pa.int32()), counts), pa.array(same, pa.bool_())],
                                      ["doc_id", "giant", "part", "place", "n_bytes", "ids", "decoded"])


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces_of(path)
        for batch in batches:
            for row, end, data, offsets in X.slices(normalised(batch.column("text"))):
                zero = X.longs(np.zeros(end - row, np.int64))
                yield _emit(vocabulary, batch.column("doc_id").slice(row, end - row), pa.nulls(end - row, pa.int64()), zero, zero, data, offsets)
    return run


def _chunks(path: str, chunk_bytes: int):
    """Chunks of giant texts, each with the bytes behind it into which its last piece may reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = pieces_of(path).longest
        for batch in batches:
            for row, key in enumerate(batch.column("key").to_pylist()):
                data, _ = X.string_buffer(normalised(batch.column("text").slice(row, 1)))
                doc = batch.column("doc_id")[row].as_py()
                for part, at in enumerate(range(0, len(data), chunk_bytes)):
                    end = min(at + chunk_bytes, len(data))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], kind) for v, kind in ((key, pa.int64()), (doc, pa.int64()), (part, pa.int64()), (at, pa.int64()), (end - at, pa.int64()),
                                                             (data[at:end + reach].tobytes(), pa.binary()))], ["key", "doc_id", "part", "place", "size", "body"])
    return run


def _transfers(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces_of(path)
        for batch in batches:
            found = [vocabulary.transfer(np.frombuffer(body, np.uint8), size).tobytes()
                     for body, size in zip(batch.column("body").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), pa.array(found, pa.binary())], ["key", "part", "matrix"])
    return run


def _matrices(table: pa.Table, order: str) -> tuple[pa.Table, list[np.ndarray]]:
    table = table.sort_by(order)
    flat = [np.frombuffer(m, np.float64) for m in table.column("matrix").to_pylist()]
    return table, [m.reshape(int(len(m) ** 0.5), -1) for m in flat]


def _blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _product(table: pa.Table) -> pa.Table:
    table, matrices = _matrices(table, "part")
    return pa.table({"key": table.column("key")[:1], "block": table.column("block")[:1], "matrix": _blobs([product(matrices)])})


def _block_fronts(table: pa.Table) -> pa.Table:
    table, matrices = _matrices(table, "block")
    begin = np.full(len(matrices[0]), _NONE)
    begin[0] = 0.0
    return pa.table({"key": table.column("key"), "block": table.column("block"), "front": _blobs(fronts(matrices, begin))})


def _chunk_fronts(table: pa.Table) -> pa.Table:
    table, matrices = _matrices(table, "part")
    begin = np.frombuffer(table.column("front")[0].as_py(), np.float64)
    return pa.table({"key": table.column("key"), "part": table.column("part"), "block": table.column("block"), "front": _blobs(fronts(matrices, begin))})


def _entries(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces_of(path)
        for batch in batches:
            found = [vocabulary.entries(np.frombuffer(body, np.uint8), size, np.frombuffer(front, np.float64))
                     for body, size, front in zip(*(batch.column(c).to_pylist() for c in ("body", "size", "front")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "part", "block")), _blobs(found)], ["key", "part", "block", "map"])
    return run


def _maps(table: pa.Table, order: str) -> tuple[pa.Table, list[np.ndarray]]:
    table = table.sort_by(order)
    return table, [np.frombuffer(m, np.int64) for m in table.column("map").to_pylist()]


def _composed(table: pa.Table) -> pa.Table:
    table, maps = _maps(table, "part")
    whole = maps[-1]
    for m in maps[-2::-1]:
        whole = np.where(whole >= 0, m[whole], -1)
    return pa.table({"key": table.column("key")[:1], "block": table.column("block")[:1], "map": _blobs([whole])})


def _between_blocks(table: pa.Table) -> pa.Table:
    table, maps = _maps(table, "block")
    path = turns(maps, 0)
    return pa.table({"key": table.column("key"), "block": table.column("block"), "leave": pa.array(path[1:], pa.int64())})


def _within_block(table: pa.Table) -> pa.Table:
    table, maps = _maps(table, "part")
    path = turns(maps, table.column("leave")[0].as_py())
    return pa.table({"key": table.column("key"), "part": table.column("part"), "enter": pa.array(path[:-1], pa.int64()), "leave": pa.array(path[1:], pa.int64())})


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces_of(path)
        for batch in batches:
            bodies = [b[s:n + e] for b, s, n, e in zip(*(batch.column(c).to_pylist() for c in ("body", "enter", "size", "leave")), strict=True)]
            place = pc.add(batch.column("place"), batch.column("enter"))
            for k, body in enumerate(bodies):
                data = np.frombuffer(body, np.uint8)
                yield _emit(vocabulary, *(batch.column(c).slice(k, 1) for c in ("doc_id", "key", "part")), place.slice(k, 1), data, np.array([0, len(data)]))
    return run


def _encoded(documents: DataFrame, vocabulary: str, giant_bytes: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows of whole texts, and rows of the chunks of giant ones."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = X.with_small_batches(texts)
    giant = F.coalesce(F.octet_length("text") > giant_bytes, F.lit(False))
    plain = texts.filter(~giant).mapInArrow(_encode_rows(vocabulary), ENCODED)

    path = scratch_path(spark, "chunks")
    texts.filter(giant).withColumn("key", F.monotonically_increasing_id()).mapInArrow(
        _chunks(vocabulary, chunk_bytes), "key bigint, doc_id bigint, part bigint, place bigint, size bigint, body binary").write.parquet(path)
    chunks = spark.read.parquet(path)
    spread = chunks.repartition(spark.sparkContext.defaultParallelism * 2, "key", "part")
    path = scratch_path(spark, "transfers")
    (spread.mapInArrow(_transfers(vocabulary), "key bigint, part bigint, matrix binary")
     .withColumn("block", F.expr(f"part div {BLOCK_CHUNKS}")).write.parquet(path))
    matrices = spark.read.parquet(path)
    by = ["key", "block"]
    blocks = matrices.groupBy(*by).applyInArrow(_product, "key bigint, block bigint, matrix binary")
    front = blocks.groupBy("key").applyInArrow(_block_fronts, "key bigint, block bigint, front binary")  # a row per block of a text
    front = matrices.join(front, by).groupBy(*by).applyInArrow(_chunk_fronts, "key bigint, part bigint, block bigint, front binary")
    maps = X.written(chunks.join(front, ["key", "part"]).mapInArrow(_entries(vocabulary), "key bigint, part bigint, block bigint, map binary"))
    leaves = maps.groupBy(*by).applyInArrow(_composed, "key bigint, block bigint, map binary").groupBy("key").applyInArrow(
        _between_blocks, "key bigint, block bigint, leave bigint")
    within = maps.join(leaves, by).groupBy(*by).applyInArrow(_within_block, "key bigint, part bigint, enter bigint, leave bigint")
    return plain, chunks.join(within, ["key", "part"]).mapInArrow(_encode_chunks(vocabulary), ENCODED)


def encode(documents: DataFrame, vocabulary: str, giant_bytes: int = GIANT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Ids of each row of ``documents`` (doc_id, text): one row per text, or per chunk of a giant one.

    ``giant`` numbers the giant texts (null for the others), ``part`` their chunks; ``place`` is the first byte of
    ``ids`` in the normalised text, ``n_bytes`` their bytes, ``decoded`` whether decoding them gives these bytes
    back. The segmentation has the greatest total score, whatever the chunks. Null and empty texts have no ids.
    Repeated rows are encoded each; null ids stay null; other columns are ignored; an empty table gives no rows.

    ``vocabulary`` is read as a unigram model: its pieces and scores. From a merge model's file, whose scores are
    ranks of merges, the ids are those of the best total of these scores, not those of merging.
    """
    plain, chunked = _encoded(documents, vocabulary, giant_bytes, chunk_bytes)
    return plain.unionByName(chunked)


def digest(documents: DataFrame, vocabulary: str, giant_bytes: int = GIANT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_pieces, ids_digest, decoded) for each row of ``documents``, as ``encode`` finds the ids.

    The digest joins a hash of every id with its number in the text, so it does not depend on chunks. The chunks
    of a giant text are numbered in a window of their own: a row per chunk. No ids give 0.
    """
    def counted(rows: DataFrame, first) -> DataFrame:
        marks = F.transform("ids", lambda x, i: F.xxhash64(first + i, x))
        return rows.withColumn("mark", F.aggregate(marks, F.lit(0).cast("long"), lambda a, m: a.bitwiseXOR(m))).withColumn("n", F.size("ids").cast("long"))

    plain, chunked = _encoded(documents, vocabulary, giant_bytes, chunk_bytes)
    size = F.size("ids").cast("long")
    first = F.sum(size).over(Window.partitionBy("giant").orderBy("part")) - size
    whole = counted(plain, F.lit(0).cast("long")).select("doc_id", F.col("n").alias("n_pieces"), "mark", "decoded")
    giants = counted(chunked.withColumn("first", first), F.col("first")).groupBy("giant").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_pieces"), F.bit_xor("mark").alias("mark"), F.bool_and("decoded").alias("decoded"))
    both = whole.unionByName(giants.drop("giant"))
    return both.select("doc_id", "n_pieces", F.col("mark").cast("string").alias("ids_digest"), "decoded")


def _texts(path: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        ids = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x.values) for x in table.column("ids") if x.is_valid)])
        body = pieces_of(path).decode(ids)
        return pa.table({"doc_id": table.column("doc_id")[:1], "text": pa.array([body[1:].decode(errors="replace")], pa.string())})
    return run


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from rows of (doc_id, part, ids), the chunks of a doc_id in order of ``part``.

    The space that encoding puts in front is taken off. Null ids are none. One row per doc_id, so ids
    must be unique; the word mark decodes to a space.
    """
    return encoded.select("doc_id", "part", "ids").groupBy("doc_id").applyInArrow(_texts(vocabulary), "doc_id bigint, text string")
