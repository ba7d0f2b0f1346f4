"""Greedy word-piece lengths without building pieces.

Method: the linear longest-match automaton of Song et al., "Fast WordPiece Tokenization" (2021). A trie
of the vocabulary has failure links; a link knows how many pieces are popped when it is taken, so one
pass over a word's bytes counts its pieces. All distinct words of a slice advance together.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as X
from tidemark.llm.packing import byte_alphabet

LONG_WORD = 512


class Automaton:
    """Trie of ``pieces`` with failure links and the number of pieces that each link pops.

    A word is read behind one space: pieces that begin with a space open a word, the others follow.
    """

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = {0: False}
        for piece in pieces:
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    final[len(children)] = False
                    children.append({})
                node = children[node][byte]
            final[node] = node > 0
        self.children = children
        self.fail, self.pops = np.full(len(children), -1, np.int64), np.zeros(len(children), np.int64)
        todo = deque([0])
        while todo:  # parents before children
            node = todo.popleft()
            for byte, child in children[node].items():
                todo.append(child)
                if final[child]:
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                at, popped = int(self.fail[node]), int(self.pops[node])
                while at >= 0 and byte not in children[at]:
                    popped += int(self.pops[at])
                    at = int(self.fail[at])
                if at >= 0 and node:
                    self.fail[child], self.pops[child] = children[at][byte], popped
        edges = [(node << 8 | byte, child) for node, own in enumerate(children) for byte, child in own.items()]
        self.edges, self.ends = X.Table(np.array([e for e, _ in edges], np.int64)), np.array([c for _, c in edges], np.int64)

    def one(self, word: bytes) -> int:
        """Pieces of one word; 1 if no pieces cover it (a single unknown)."""
        node = count = 0
        for byte in b" " + word:
            while byte not in self.children[node]:
                if self.fail[node] < 0:
                    return 1
                count += int(self.pops[node])
                node = int(self.fail[node])
            node = self.children[node][byte]
        while node:
            if self.fail[node] < 0:
                return 1
            count += int(self.pops[node])
            node = int(self.fail[node])
        return count

    def _advance(self, node: np.ndarray, byte: np.ndarray, count: np.ndarray, lost: np.ndarray) -> None:
        todo = np.flatnonzero(~lost)
        while len(todo):
            at = self.edges.find(node[todo] << 8 | byte[todo])
            hit = at >= 0
            node[todo[hit]] = self.ends[at[hit]]
            todo = todo[~hit]
            self._pop(node, count, lost, todo)
            todo = todo[~lost[todo]]

    def _pop(self, node: np.ndarray, count: np.ndarray, lost: np.ndarray, which: np.ndarray) -> None:
        to = self.fail[node[which]]
        lost[which[to < 0]] = True
        count[which] += self.pops[node[which]]
        node[which] = np.maximum(to, 0)

    def many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end]."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        out = np.zeros(len(order), np.int64)
        for k in order[:int((size > LONG_WORD).sum())]:
            out[k] = self.one(data[starts[k]:ends[k]].tobytes())
        order = order[int((size > LONG_WORD).sum()):]
        node, count, lost = (np.zeros(len(order), kind) for kind in (np.int64, np.int64, bool))
        begin, length = starts[order], size[order]
        self._advance(node, np.full(len(order), 0x20, np.int64), count, lost)
        for at in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -at, "left"))  # words longer than ``at`` come first
            self._advance(node[:n], data[begin[:n] + at].astype(np.int64), count[:n], lost[:n])
        todo = np.flatnonzero((node != 0) & ~lost)
        while len(todo):
            self._pop(node, count, lost, todo)
            todo = todo[(node[todo] != 0) & ~lost[todo]]
        out[order] = np.where(lost, 1, count)
        return out


def byte_level_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file, without its special tokens."""
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    back, special = byte_alphabet(), {t["content"] for t in spec.get("added_tokens", [])}
    return [bytes(back[c] for c in token) for token in spec["model"]["vocab"] if token not in special]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(byte_level_pieces(path))
        for batch in batches:
            for row, end, data, offsets in X.slices(batch.column("text")):
                words = X.Words(data, offsets)
                _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
                pieces = automaton.many(data, words.starts[first], words.ends[first])
                total = np.concatenate([[0], np.cumsum(pieces[which])])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), X.longs(words.counts), X.longs(np.diff(total[words.first]))],
                                                 ["doc_id", "n_words", "n_tokens"])
    return run


def count_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of ``documents`` (doc_id, text).

    ``n_tokens`` sums, over the words of the text, the pieces of longest match from the left; a word that
    pieces cannot cover is one. Null and empty texts have none. Rows are independent of each other;
    other columns are ignored; an empty table gives no rows.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return X.with_small_batches(texts).mapInArrow(_count(vocabulary), "doc_id bigint, n_words bigint, n_tokens bigint")
