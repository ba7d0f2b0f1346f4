"""Merkle manifest of a table: a tree per source, a tree over the sources, and a witness for each row.

Method: incremental witnesses. Rows of a source lie in order and are cut into aligned blocks of 3**levels
rows. A task appends the rows of a block one by one; every completed run of three hands each open subtree
below it the siblings that its rows lacked, so a witness grows with the tree and no tree is kept. The
block's root is then a row of the next round: it is appended in the same way, until one node is left.

Nodes have three children at most. H is SHA-256 over the lowercase hex of the children, one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.cluster import join_small, scratch_path, settle
from tidemark.llm import text as X

FAN = 3
#: Levels of a block: 2187 rows.
BLOCK_LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 (binary) of the five fields, each ``-`` if null, else its number of bytes, ``:`` and its text."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent_of(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


class OpenSubtrees:
    """One block while rows are appended: at each level the nodes whose run is not complete yet."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels + 1)]
        self.siblings: list[list[bytes]] = []  # what each row has gathered, level by level
        self.steps: list[bytearray] = []       # 3 * (siblings on the left) + (siblings on the right), a byte per level

    def append(self, digest: bytes) -> None:
        at = len(self.siblings)
        self.siblings.append([])
        self.steps.append(bytearray())
        self._add(0, (digest, at, at + 1))

    def _add(self, level: int, node: tuple[bytes, int, int]) -> None:
        self.open[level].append(node)
        if len(self.open[level]) == FAN and level < self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for k, (_, first, end) in enumerate(run):
            others = digests[:k] + digests[k + 1:]
            step = FAN * k + len(run) - 1 - k
            for row in range(first, end):
                self.siblings[row] += others
                self.steps[row].append(step)
        self._add(level + 1, (parent_of(digests), run[0][1], run[-1][2]))

    def close(self, alone: bool) -> bytes:
        """Root of what was appended; a block that is the whole tree stops at the first single node."""
        for level in range(self.levels):
            if not self.open[level] or alone and len(self.open[level]) == 1 and not any(self.open[level + 1:]):
                continue
            self._complete(level)
        return next(nodes[0][0] for nodes in self.open if nodes)


def _append_blocks(levels: int):
    """Rows in order of block and position to the same rows with ``proof``, ``steps``, and ``top`` on the first row of a block."""
    size = FAN ** levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, alone = None, None, False
        proofs, steps, tops = [], [], []

        def finish() -> None:
            top = block.close(alone)
            proofs.extend(b"".join(s) for s in block.siblings)
            steps.extend(bytes(s) for s in block.steps)
            tops.extend([top] + [None] * (len(block.steps) - 1))

        def ready(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = {"proof": pa.array(proofs, pa.binary()), "steps": pa.array(steps, pa.binary()), "top": pa.array(tops, pa.binary())}
            out = table.slice(0, len(proofs))
            for name, values in columns.items():
                out = out.append_column(name, values)
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for position, total, node in zip(batch.column("pos").to_pylist(), batch.column("total").to_pylist(), batch.column("node").to_pylist(), strict=True):
                if position % size == 0:
                    if block is not None:
                        finish()
                    block, alone = OpenSubtrees(levels), total <= size
                block.append(node)
            held = rows if held is None else pa.concat_tables([held, rows])
            if proofs:
                yield from ready(held)
                held = held.slice(len(proofs))
                proofs, steps, tops = [], [], []
        if block is not None:
            finish()
            yield from ready(held)
    return run


def placed(nodes: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos``, its place in its group by ``order`` (nulls first), and ``total``, the group's size.

    Groups are cut by ranges of the order, so a hot group lies in many tasks; what the ranges hold of each
    group is counted and summed up. Rows that tie take places next to each other and may lie in several tasks.
    """
    spark = nodes.sparkSession
    path = scratch_path(spark, "ordered")
    ordered = nodes.withColumn("__from", F.spark_partition_id()).repartitionByRange(group, *order, "__from").sortWithinPartitions(group, *order)
    ordered.drop("__from").withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumns({"__range": F.shiftright("__at", 33), "__group": F.struct(group)})
    counts = rows.groupBy("__group", "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    whole = W.partitionBy("__group")  # a row per range at most
    counts = settle(counts.select("__group", "__range", "__first", F.sum("__n").over(whole).alias("total"),
                                  (F.sum("__n").over(whole.orderBy("__range")) - F.col("__n")).alias("__before")))
    found = join_small(rows, counts, ["__group", "__range"], salts=1)
    return found.withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop(
        "__group", "__range", "__first", "__before", "__at")


def witnesses(nodes: DataFrame, group: str, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``nodes`` (group, pos, total, node) with ``proof``, ``steps`` and ``root`` of the tree of their group."""
    size = FAN ** levels
    block = F.expr(f"pos div {size}")
    keyed = nodes.withColumns({"__group": F.struct(group), "__block": block})
    ordered = X.with_small_batches(keyed.repartition("__group", "__block").sortWithinPartitions("__group", "__block", "pos"))
    kind = ", ".join(f"`{n}` {t}" for n, t in nodes.dtypes) + ", proof binary, steps binary, top binary"
    done = X.written(ordered.select(*nodes.columns).mapInArrow(_append_blocks(levels), kind))
    heads = done.filter("top IS NOT NULL").select(group, block.alias("pos"), F.expr(f"(total + {size - 1}) div {size}").alias("total"), F.col("top").alias("node"))
    if heads.filter("total > 1").isEmpty():
        above = heads.select(group, "pos", F.col("node").alias("root"), F.lit(b"").alias("proof"), F.lit(b"").alias("steps"))
    else:
        above = witnesses(heads, group, levels)
    above = settle(above.select(F.struct(group).alias("__group"), F.col("pos").alias("__block"), F.col("root"),
                                F.col("proof").alias("__proof"), F.col("steps").alias("__steps")))
    joined = join_small(done.withColumns({"__group": F.struct(group), "__block": block}), above, ["__group", "__block"], salts=1)
    return joined.select(*nodes.columns, F.concat("proof", "__proof").alias("proof"), F.concat("steps", "__steps").alias("steps"), "root")


def manifest(documents: DataFrame, carry: Sequence[str] = (), levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, source, pos, leaf, subroot, root, proof, steps, columns of ``carry``) for each row of ``documents``.

    ``leaf``, ``subroot`` and ``root`` are binary digests, ``proof`` holds the siblings of 32 bytes each, from
    the leaf up to the root, and ``steps`` a byte per level: 3 * siblings on the left + siblings on the right.

    Rows ascend by doc_id in their source, null first; rows of one doc_id ascend by leaf, and equal rows are
    leaves of their own. A null source is a source, before all others. Null fields are written as ``-``, so an
    empty text differs from none. Columns other than the five fields count only if carried. An empty table
    gives no rows. Memory follows a block of 3**levels rows, whatever the size of a source.
    """
    kept = F.struct(F.lit(0).alias("__none"), *carry)
    leaves = X.written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                        leaf_digest().alias("node"), kept.alias("carry")))
    rows = X.written(witnesses(placed(leaves, "source", ["doc_id", "node"]), "source", levels).withColumnRenamed("root", "subroot"))
    sources = rows.filter("pos = 0").select(F.lit(0).alias("all"), "source", F.col("subroot").alias("node"))
    top = witnesses(placed(sources, "all", ["source"]), "all", levels)
    top = settle(top.select(F.struct("source").alias("__source"), "root", F.col("proof").alias("__proof"), F.col("steps").alias("__steps")))
    joined = join_small(rows.withColumn("__source", F.struct("source")), top, ["__source"])
    return joined.select("doc_id", "source", "pos", F.col("node").alias("leaf"), "subroot", "root",
                         F.concat("proof", "__proof").alias("proof"), F.concat("steps", "__steps").alias("steps"),
                         *(F.col("carry")[name].alias(name) for name in carry))


def fold(leaf: bytes, proof: bytes, steps: bytes) -> bytes:
    """The root that ``leaf`` and the siblings lead to."""
    digest, at = leaf.hex(), 0
    siblings = proof.hex()
    for step in steps:
        left, right = divmod(step, FAN)
        middle, end = at + 64 * left, at + 64 * (left + right)
        digest = hashlib.sha256((siblings[at:middle] + digest + siblings[middle:end]).encode()).hexdigest()
        at = end
    return bytes.fromhex(digest)


def folded(rows: DataFrame, leaf: str, out: str = "folded") -> DataFrame:
    """``rows`` of a manifest with the root to which the digest in ``leaf`` leads; a null one leads nowhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if row is None else fold(row, p, s) for row, p, s in zip(*(batch.column(c).to_pylist() for c in (leaf, "proof", "steps")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, out])

    return X.with_small_batches(rows).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{out}` binary")


#: For ids that differ, with the CRC-32 of the id written out.
ORACLE = r"""
WITH RECURSIVE
crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), range(8)::BIGINT[]), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)))) AS state
  FROM documents),
leaves AS (
  SELECT d.doc_id, source, row_number() OVER (PARTITION BY source ORDER BY d.doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total,
    sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(shown)::VARCHAR || ':' || shown, '-')) AS shown_leaf
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
          || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
          CASE WHEN xor(state, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown
        FROM documents JOIN crc USING (doc_id)) d),
nodes AS (
  SELECT 0 AS level, source, pos, leaf AS node, total FROM leaves
  UNION ALL
  SELECT level + 1, source, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(total) + 2) // 3
  FROM nodes WHERE total > 1 GROUP BY level, source, pos // 3),
subroots AS (SELECT source, node, level AS height, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS pos, count(*) OVER () AS total FROM nodes WHERE total = 1),
tops AS (
  SELECT 0 AS level, pos, node, total FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(total) + 2) // 3 FROM tops WHERE total > 1 GROUP BY level, pos // 3),
steps AS (
  SELECT doc_id, n.level AS step, n.pos - l.pos // (3 ** n.level)::BIGINT AS side, n.node
  FROM leaves l JOIN nodes n ON n.source IS NOT DISTINCT FROM l.source AND n.total > 1 AND n.pos // 3 = l.pos // (3 ** (n.level + 1))::BIGINT
  UNION ALL
  SELECT doc_id, s.height + t.level, t.pos - s.pos // (3 ** t.level)::BIGINT, t.node
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tops t ON t.total > 1 AND t.pos // 3 = s.pos // (3 ** (t.level + 1))::BIGINT),
runs AS (
  SELECT doc_id, step, coalesce(string_agg(node, '' ORDER BY side) FILTER (WHERE side < 0), '') AS before, coalesce(string_agg(node, '' ORDER BY side) FILTER (WHERE side > 0), '') AS behind
  FROM steps GROUP BY doc_id, step),
proofs AS (SELECT doc_id, sha256(string_agg(before || behind, '' ORDER BY step)) AS proof_sha256 FROM runs GROUP BY doc_id),
folds AS (
  SELECT doc_id, 0 AS step, shown_leaf AS digest FROM leaves
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(before || digest || behind) FROM folds f JOIN runs r ON r.doc_id = f.doc_id AND r.step = f.step)
SELECT l.doc_id, leaf, s.node AS subroot, t.node AS root, folded_root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root = t.node AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tops t ON t.total = 1 LEFT JOIN proofs p ON p.doc_id = l.doc_id
JOIN (SELECT doc_id, arg_max(digest, step) AS folded_root FROM folds GROUP BY doc_id) f ON f.doc_id = l.doc_id
"""
