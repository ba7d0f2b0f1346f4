"""Linked sets keep a part in common, whatever is taken as common; chains of common lines are cut."""

import numpy as np
import pytest

from tidemark.llm import ngram_jaccard as J
from tidemark.llm import text as X


def names_of(sets, sim, seed, common):
    counts = np.array([len(s) for s in sets])
    return J._part_names(np.concatenate(sets), counts, sim, seed, common)


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5), (1, 2)])
@pytest.mark.parametrize("told", ["none", "all", "half", "shared", "few"])
def test_linked_sets_share_a_part(num, den, told):
    sim, rng = J.Similarity(num, den), np.random.default_rng(12)
    for trial in range(150):
        size = int(rng.choice([1, 2, 3, 7, 8, 20, 64, 150, 400, 1500]))
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        # drop and add as much as the similarity allows
        most = (len(a) * (den - num)) // den
        gone = int(rng.integers(0, most + 1))
        b = np.delete(a, rng.choice(len(a), gone, replace=False))
        extra = 0
        while len(b) and sim.links(np.array(len(b)), np.array(len(a)), np.array(len(b) + extra + 1)) and rng.random() < 0.97:
            extra += 1
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 62, extra).astype(np.uint64)]))
        common = np.intersect1d(a, b)
        if not len(common) or not sim.links(np.array(len(common)), np.array(len(a)), np.array(len(b))):
            continue
        table = {"none": None, "all": np.union1d(a, b), "half": np.union1d(a, b)[::2], "shared": common, "few": common[:2]}[told]
        parts, owner = names_of([a, b], sim, trial % 5, None if table is None else X.Table(table))
        assert set(parts[owner == 0]) & set(parts[owner == 1]), (size, gone, extra)


def test_common_shingles_leave_parts_out():
    """Sets with nothing but common shingles between them share fewer parts when these are known."""
    sim, rng = J.Similarity(4, 5), np.random.default_rng(13)
    line = rng.integers(0, 1 << 62, 12).astype(np.uint64)
    sets = [np.sort(np.concatenate([line, rng.integers(0, 1 << 62, 288).astype(np.uint64)])) for _ in range(300)]

    def tied(common):
        parts, owner = names_of(sets, sim, 0, common)
        names, n = np.unique(parts, return_counts=True)
        return len(np.unique(owner[np.isin(parts, names[n > 1])]))

    assert tied(None) > 20 and tied(X.Table(np.sort(line))) == 0


def test_common_shingles_of_a_table(spark):
    rows = [(k, f"head of line shared by all w{k} x{k} y{k}") for k in range(30)] + [(None, "head of line shared by all"), (99, None)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = J.common_shingles(texts, 32, 4)
    assert len(found) == 3 and len(J.common_shingles(texts.limit(0), 0, 4)) == 0


def test_sample_grows_with_the_table(spark, monkeypatch):
    """A line that one document in twenty holds is found in a sample of a twentieth, though a fixed one would hold it once."""
    monkeypatch.setattr(J, "SAMPLE_DOCS", 20)
    rows = [(i, "a line that many hold" if i % 20 == 7 else " ".join(f"w{i}x{k}" for k in range(5))) for i in range(4000)]
    found = J.common_shingles(X.with_small_batches(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)), len(rows), 4)
    line = b"a line that many hold"
    names, _ = J.shingle_sets(X.Words(np.frombuffer(line, np.uint8), np.array([0, len(line)])), 4)
    assert set(names) == set(found)
