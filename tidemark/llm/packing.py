"""Pack token sequences of fixed length with balanced attention cost.

Method: cost-balanced packing. A piece of n tokens costs ``LINEAR * n + QUADRATIC * n**2``. Documents
are dealt in descending order of cost, each to the sequence of lowest cost that has room. It runs
within blocks of documents of one partition, as large as ``BLOCK_TOKENS``: no shuffle, bounded memory,
and a task that is run again packs the same way.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as X

CAPACITY = 2048
BLOCK_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
END_ID = 1

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


class Encoder:
    """Ids of a byte-level BPE vocabulary file, without special tokens added.

    The file's own library gives the ids. Where every merge ranks as its token's id, as in files of this
    kind, a rank-based encoder gives the same ids in a quarter of the time and takes its place; texts
    that hold a special token still go to the library.
    """

    def __init__(self, path: str):
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = _rank_encoder(spec)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast(text), np.uint32)


#: Pattern of byte-level BPE, fixed value of the format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Byte of each printable stand-in of the format: printable bytes as they are, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _rank_encoder(spec: dict):
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer")
            or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")):
        return None
    vocab, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(b <= a for a, b in zip(merged, merged[1:], strict=False)):
        return None
    import tiktoken

    back = byte_alphabet()
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack_block(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that hold each token of a block once.

    Stretches of ``capacity`` tokens fill sequences of their own. The rests are dealt in descending
    order of cost to as many sequences as they need at least, each to the cheapest with room; one that
    fits nowhere is cut over the emptiest. What the last sequence would leave open is avoided: its
    tokens go to sequences whose lengths are powers of two, which need no padding.
    """
    pieces, sequences, rests = [], 0, []
    for d, n in enumerate(lengths):
        for at in range(0, n - n % capacity, capacity):
            pieces.append((d, at, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rests.append((n % capacity, d))
    rests.sort(key=lambda x: (-cost(x[0]), x[1]))
    total = sum(n for n, _ in rests)
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    room, spent, used = np.array(sizes, np.int64), np.zeros(len(sizes)), [0] * len(sizes)

    def put(d: int, at: int, n: int, s: int) -> None:
        pieces.append((d, at, n, sequences + s, used[s]))
        used[s] += n
        room[s] -= n
        spent[s] += cost(n)

    left = []
    for n, d in rests:
        s = int(np.where(room >= n, spent, np.inf).argmin()) if len(room) else 0
        if len(room) and room[s] >= n:
            put(d, lengths[d] - n, n, s)
        else:
            left.append((n, d, lengths[d] - n))
    emptiest = np.argsort(-room, kind="stable").tolist()
    for n, d, at in left:
        while n:
            s = emptiest[0]
            take = min(int(room[s]), n)
            put(d, at, take, s)
            at, n = at + take, n - take
            if not room[s]:
                emptiest.pop(0)
    return pieces


def _pack(path: str, capacity: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        base = TaskContext.get().partitionId() << 40
        docs, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            pieces = pack_block([len(ids) for _, ids in docs], capacity)
            out = [(docs[d][0], at, n, zlib.crc32(docs[d][1][at:at + n].tobytes()), len(docs[d][1]), base + s, o) for d, at, n, s, o in pieces]
            base += 1 + max(p[3] for p in pieces)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                              ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                docs.append((doc.as_py(), ids))
                held += len(ids)
                if held >= block_tokens:
                    yield flush()
                    docs, held = [], 0
        if docs:
            yield flush()
    return run


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of each row of ``documents`` (doc_id, text), see ``PIECES``.

    A document is its text's ids and then ``END_ID``; a null text is empty, so it still has one token.
    ``sequence_id`` is unique over the table, pieces of a sequence lie gapless from offset 0, and every
    sequence holds ``capacity`` tokens or a power of two, so none needs padding. Repeated rows are
    packed each; a null doc_id stays null. Other columns are ignored; an empty table gives no rows.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return X.with_small_batches(texts).mapInArrow(_pack(tokenizer, capacity, block_tokens), PIECES)
