"""Words and hashes of whole Arrow batches, and the shapes that operators pass on.

A word is a maximal run of bytes other than ASCII space and ``\\t\\n\\v\\f\\r``. Texts are handled a
slice of rows at a time, so that a worker's memory follows ``SLICE_BYTES`` or the longest text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cluster import scratch_path

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
BROADCAST_IDS = 500_000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_random = np.random.default_rng(20_26)
_BYTE = _random.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_PLACE = _random.integers(1, 2**63, (2, 64), np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    return out[:n]


_UP, _DOWN = _powers(_BASE, SLICE_BYTES + 1), _powers(_BASE_INVERSE, SLICE_BYTES + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def limit_batches(spark: SparkSession) -> None:
    """Small Arrow batches, as one batch of texts lies in memory on both sides.

    Workers on this machine also learn where the package lies, in case it was only put on the driver's path.
    """
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known.get("PYTHONPATH")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.

    A loop reads such a table as a plain file: unlike a checkpoint it hands no constraints of its old
    plan on to the next round, where they would multiply on the driver.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(ids: DataFrame) -> DataFrame:
    """A table of ids marked for broadcast if a count shows at most ``BROADCAST_IDS`` rows, else as it is: joins then shuffle."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def with_small_batches(df: DataFrame) -> DataFrame:
    limit_batches(df.sparkSession)
    return df


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and where each row begins and ends. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes, one row at least."""
    data, offsets = string_buffer(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class Words:
    """Words of one slice: byte spans, hashes, and the range of words of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
        self.data = data
        inside = ~space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
        self.ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes; working memory is bounded whatever the slice."""
        out = np.empty(len(self.starts), np.uint64)
        done = 0
        while done < len(out):
            base = self.starts[done]
            end = int(np.searchsorted(self.ends, base + SLICE_BYTES, "right"))
            if end <= done:  # a single word that is longer than a slice
                out[done] = _long_hash(self.data[base:self.ends[done]])
                done += 1
                continue
            part = self.data[base:self.ends[end - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * _UP[:len(part)], out=sums[1:])
            begin, stop = self.starts[done:end] - base, self.ends[done:end] - base
            out[done:end] = mix((sums[stop] - sums[begin]) * _DOWN[begin] + (stop - begin).astype(np.uint64))
            done = end
        return out

    def window_starts(self, width: int) -> np.ndarray:
        """First words of all windows of ``width`` words that stay within a row."""
        last = self.first[1:] - width
        fits = last >= self.first[:-1]
        size = np.where(fits, last - self.first[:-1] + 1, 0)
        return ramp(self.first[:-1], size)

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each row's words (those of ``keep``) with one space between them: bytes and where rows begin and end."""
        begin, stop, first = self.starts, self.ends, self.first
        if keep is not None:
            begin, stop, first = begin[keep], stop[keep], np.concatenate([[0], np.cumsum(keep)])[first]
        edge = np.zeros(len(self.data) + 2, np.int8)
        edge[begin] += 1
        spaced = np.ones(len(begin), bool)  # the byte behind a word becomes its space, but for a row's last word
        spaced[first[1:][np.diff(first) > 0] - 1] = False
        edge[stop + spaced] -= 1
        held = np.cumsum(edge[:-2], dtype=np.int8).astype(bool)
        out = self.data.copy()
        out[stop[spaced]] = 0x20
        ends = np.concatenate([[0], np.cumsum(stop - begin + spaced)])
        return out[held], ends[first]


def _long_hash(data: np.ndarray) -> np.uint64:
    total = np.zeros(1, np.uint64)
    for at in range(0, len(data), SLICE_BYTES):
        part = data[at:at + SLICE_BYTES]
        total = mix(total + np.add.reduce(_BYTE[part] * _UP[:len(part)], keepdims=True))
    return mix(total + np.uint64(len(data)))[0]


def ramp(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for sizes[0] entries, then the same for the next."""
    total = int(sizes.sum())
    skip = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return np.arange(total, dtype=np.int64) + skip


def window_hash(hashes: np.ndarray, starts: np.ndarray, width: int, variant: int = 0) -> np.ndarray:
    """64-bit hash of ``width`` consecutive word hashes from each of ``starts``."""
    total = np.full(len(starts), np.uint64(width), np.uint64)
    for k in range(width):
        total += hashes[starts + k] * _PLACE[variant, k]
    return mix(total)


class Table:
    """Positions of 64-bit keys, looked up many at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys) + 8).bit_length())
        self.keys, self.slots, self.steps = keys, np.full(1 << self.bits, -1, np.int32), 0
        left = np.arange(len(keys))
        while len(left):
            at = self._slot(keys[left], self.steps)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            self.steps += 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64) + np.uint64(step << 48)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for step in range(self.steps):
            at = self.slots[self._slot(keys[left], step)]
            some = at >= 0
            left, at = left[some], at[some]
            hit = self.keys[at] == keys[left]
            found[left[hit]] = at[hit]
            left = left[~hit]
            if not len(left):
                break
        return found


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def int64_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and which of them are not null."""
    valid = np.asarray(column.is_valid())
    return np.asarray(column.cast(pa.int64()).fill_null(0)), valid


def list_row(fields: dict[str, pa.Array]) -> pa.Array:
    """One row that holds a list of structs."""
    columns = list(fields.values())
    inner = pa.StructArray.from_arrays(columns, names=list(fields))
    return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(signed(x) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def lists_of(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list per row from values that lie one row after another."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def distinct_pairs(names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (name, row), ordered by both."""
    order = np.lexsort((rows, names))
    names, rows = names[order], rows[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])
    return names[new], rows[new]


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in ordered keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)
