"""Near vectors against brute force, in tables whose links cross many cells."""

import numpy as np
import pytest

from tidemark.llm import embedding_dedup


def by_hand(rows, threshold=0.95):
    """(links, smallest id that links reach) of every id with a usable vector."""
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    unit = vectors / np.abs(vectors).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    near = [np.flatnonzero(unit @ unit[k] >= threshold) for k in range(len(ids))]
    for k, found in enumerate(near):
        links[k] = len(found) - 1
    for start in np.argsort(ids):
        if root[start] != start:
            continue
        todo, seen = [start], {start}
        while todo:
            for m in near[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        for m in seen:
            if ids[start] <= ids[root[m]]:
                root[m] = start
    return {int(i): (int(n), int(ids[r])) for i, n, r in zip(ids, links, root, strict=True)}


def found(spark, rows, kind="float"):
    table = spark.createDataFrame([(i, v, "x", -1) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, cell string, n_links int").repartition(4)
    return {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table).collect() if r.kept == (r.vec_id == r.component_id)}


@pytest.mark.parametrize("cells,block,visitors", [(400, 300, 500), (100, 64, 1000), (4096, 4096, 16_384)])
def test_all_links_across_many_cells(spark, monkeypatch, cells, block, visitors):
    """A dense region that many centres share, chains of neighbours, and vectors in all directions."""
    monkeypatch.setattr(embedding_dedup, "CELL_VECTORS", cells)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "VISITORS", visitors)
    rng = np.random.default_rng(9)
    dense = np.array([3.0, *[0.0] * 11]) + rng.normal(size=(2500, 12)) * 0.17
    spread = rng.normal(size=(2000, 12))
    chain = np.array([[np.cos(t), np.sin(t), *[0.0] * 10] for t in np.arange(300) * 0.02])
    vectors = np.concatenate([dense, spread, spread[:200] + rng.normal(size=(200, 12)) * 0.1, chain]).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    want = by_hand(rows)
    assert found(spark, rows) == want and sum(n for n, _ in want.values()) > 1_000_000


def test_twenty_thousand_vectors_and_fifty_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_VECTORS", 400)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 512)
    rng = np.random.default_rng(10)
    centre = rng.normal(size=32)
    vectors = np.concatenate([centre + rng.normal(size=(14_000, 32)) * 0.22, rng.normal(size=(6000, 32))]).astype(np.float32)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    links = sum((unit[k:k + 2000] @ unit.T >= 0.95).sum() for k in range(0, 20_000, 2000)) - 20_000
    got = found(spark, [(k, v.tolist()) for k, v in enumerate(vectors)])
    assert sum(n for n, _ in got.values()) == links > 1_000_000
    some = rng.integers(0, 20_000, 200)
    assert [got[int(k)][0] for k in some] == ((unit[some] @ unit.T >= 0.95).sum(1) - 1).tolist()


def test_links_at_the_threshold_are_settled_in_double(spark):
    """Products that single precision cannot tell from 0.95."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 8))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = 0.95 + rng.integers(-3, 4, size=(400, 1)) * 1e-9
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, base * cosine + side * np.sqrt(1 - cosine * cosine)]))]
    got, want = found(spark, rows, "double"), by_hand(rows)
    near = [k for k in range(400) if abs(cosine[k, 0] - 0.95) > 1e-12]  # the others hang on the last bit of a sum
    assert all(got[k] == want[k] for k in near) and 100 < sum(got[k][0] for k in near) < 300


def test_rows_that_repeat_or_lack_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a), (5, a), (2, a), (9, b), (9, a), (None, a), (7, None), (8, [0.0, 0.0, 0.0]), (1, [1e30, 1e30, 0.0]), (3, [1e-30, 1e-30, 0.0]), (4, [1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table).collect())
    assert got == [(False, 1, 1, 1, True), (False, 2, 2, 2, True), (False, 3, 1, 1, False), (False, 4, 0, 4, True), (False, 5, 2, 2, False), (False, 5, 2, 2, False),
                   (False, 7, 0, 7, True), (False, 8, 0, 8, True), (False, 9, 2, 2, False), (False, 9, 2, 2, False), (True, None, 0, None, True)]
