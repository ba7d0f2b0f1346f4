"""Phrase mining, prefix forest and Merkle manifest against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle_manifest, phrase_mining, prefix_forest, queries

# --- phrases -----------------------------------------------------------------------------


def phrases_by_hand(rows, least, longest, top):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        wanted = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        held = {q for p, n in wanted.items() for a in range(len(p)) for b in range(a + 2, len(p) + 1)
                for q in [p[a:b]] if len(q) < len(p) and 100 * n >= 100 * f[q]}
        found = []
        for p, a in wanted.items():
            if p not in held:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], total[lang], score))
        for rank, (_, _, phrase, a, left, right, n, score) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n, score))
    return sorted(out)


def mined(frame, *options):
    return sorted(tuple(r) for r in phrase_mining.phrases(frame, *options).collect())


KIND = "doc_id bigint, text string, lang string, word string, n bigint"
ODD = [("en", "New York is New\tYork, new york; is\nnew york!"), ("en", None), (None, "a a a a a a a. a a"), ("und", "a a a b\x01 b b\x01"), ("en", ""), ("de", " \t "),
       ("en", "é É ß é É ß é"), ("en", "x\x0by z\x0cx y z"), ("", "lang is empty lang is empty"), ("en", "...,,,"), ("de", "ein wort ein wort")]


@pytest.mark.parametrize("least,longest,top", [(2, 5, 2000), (1, 5, 7), (3, 2, 2000), (2, 3, 1)])
def test_phrases_on_awkward_rows(spark, least, longest, top):
    rows = ODD * 2
    frame = spark.createDataFrame([(k, t, lang, "w", 0) for k, (lang, t) in enumerate(rows)], KIND)
    assert mined(frame, least, longest, top) == phrases_by_hand(rows, least, longest, top)


@pytest.mark.parametrize("prune", [1_000_000, 0, 30])
def test_phrases_of_documents(spark, sf_dir, monkeypatch, prune):
    """Leaving out early what cannot be frequent changes nothing; nor does cutting the order into ranges."""
    monkeypatch.setattr(phrase_mining, "PRUNE_ROWS", prune)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.lang, r.text) for r in documents.collect()]
    assert mined(documents, 20, 5, 300) == phrases_by_hand(rows, 20, 5, 300)


def test_a_common_first_word_lies_in_many_ranges(spark):
    rows = [("en", " ".join(f"the w{k} v{k % 7}" for k in range(300)) + ".") for _ in range(3)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert mined(frame, 3, 5, 5000) == phrases_by_hand(rows, 3, 5, 5000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_scores_are_exact_beyond_64_bits(spark):
    """The arithmetic of the score on counts of a large corpus."""
    a, n, left, right = 3_000_000_007, 9_000_000_000_011, 4_000_000_019, 3_000_000_019
    big = "CAST({} AS DECIMAL(20, 0))"
    text = f"CAST(CAST(1000 AS DECIMAL(4, 0)) * ({big.format('a')} * {big.format('n')}) div ({big.format('l')} * {big.format('r')}) AS BIGINT)"
    row = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint").select(F.expr(text)).first()
    assert row[0] == 1000 * a * n // (left * right) and a * n > 1 << 64


def test_two_words_of_one_name_get_other_names(spark, monkeypatch):
    """Names that stand for two words are noticed, and all words are named anew."""
    real, used = phrase_mining.Sequence_, []

    class Colliding(real):
        def __init__(self, data, offsets, langs, naming):
            super().__init__(data, offsets, langs, naming)
            if naming == 0:
                self.names = self.names & np.uint64(1)

    real_count = phrase_mining._count_words
    monkeypatch.setattr(phrase_mining, "_count_words", lambda naming: (used.append(naming), _with(Colliding, real_count(naming)))[1])
    rows = [("en", "one two three one two three one two")] * 2
    assert mined(spark.createDataFrame(rows, "lang string, text string"), 2, 5, 10) == phrases_by_hand(rows, 2, 5, 10) and used == [0, 1]


def _with(kind, run):
    def patched(batches):
        kept, phrase_mining.Sequence_ = phrase_mining.Sequence_, kind
        try:
            yield from run(batches)
        finally:
            phrase_mining.Sequence_ = kept
    return patched


def test_phrases_of_long_texts_and_words(spark):
    rows = [("en", ("up and down " * 120_000) + "w" * 2_000_000 + " up and down")]
    assert mined(spark.createDataFrame(rows, "lang string, text string"), 100, 5, 20) == phrases_by_hand(rows, 100, 5, 20)


def test_no_phrases(spark):
    assert mined(spark.createDataFrame([], "lang string, text string"), 1, 5, 10) == []
    assert mined(spark.createDataFrame([(None, None), ("en", "alone")], "lang string, text string"), 1, 5, 10) == []


# --- nearest neighbours --------------------------------------------------------------------


def near_by_hand(rows, every, count):
    known = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            known[i] = min(known.get(i, v), v)
    ids = np.array(sorted(known))
    vectors = np.array([known[i] for i in ids], float)
    out = {}
    for i in ids[ids % every == 0]:
        scores = vectors @ np.array(known[i], float)
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != i][:count]
        out[int(i)] = [(int(ids[k]), scores[k]) for k in order]
    return out


def found_by(frame, *options):
    out = collections.defaultdict(list)
    for r in sorted(prefix_forest.nearest(frame, *options).collect()):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def recall(found, want):
    return sum(len({v for v, _ in found[i]} & {v for v, _ in w}) for i, w in want.items()) / sum(map(len, want.values()))


def test_neighbours_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = near_by_hand([(r.vec_id, r.embedding) for r in table.collect()], 20, 20)
    found = found_by(table)
    assert set(found) == set(want) and recall(found, want) >= 0.95
    for i, near in found.items():
        assert np.allclose([s for _, s in near], [s for _, s in want[i]], atol=1e-12) or recall({i: near}, {i: want[i]}) < 1


@pytest.mark.parametrize("norms", [False, True])
def test_recall_in_clusters(spark, monkeypatch, norms):
    """Dense regions, tiles far smaller than the table, vectors of many lengths: most rows are never scored."""
    monkeypatch.setattr(prefix_forest, "TILE_ROWS", 64)
    monkeypatch.setattr(prefix_forest, "BLOCK", 128)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24)) * 3
    vectors = (centres[rng.integers(0, 60, 4000) % 60] + rng.normal(size=(4000, 24)) * 0.4).astype(np.float32)
    if norms:
        vectors *= rng.uniform(0.9, 1.0, size=(4000, 1)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert recall(found_by(table), near_by_hand(rows, 20, 20)) >= 0.95


def test_copies_of_one_vector(spark):
    """A third of the rows are one vector; its ids tie, the smallest come first, and each query leaves itself out."""
    rng = np.random.default_rng(4)
    same = [1.0, 2.0, 0.5, 0.0]
    rows = [(k, same if k % 3 == 0 else rng.normal(size=4).tolist()) for k in range(600)]
    table = spark.createDataFrame([(k, v, "x", 1.0) for k, v in rows], "vec_id bigint, embedding array<double>, ids string, score double")
    found, want = found_by(table, 20, 20), near_by_hand(rows, 20, 20)
    assert {i: [v for v, _ in w] for i, w in found.items()} == {i: [v for v, _ in w] for i, w in want.items()}


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.9, 0.1]), (2, None), (40, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]),
            (6, [1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.0]), (20, [0.5, 0.5]), (60, [])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found_by(table) == {0: [(1, 0.9), (20, 0.5), (7, -1.0)], 20: [(0, 0.5), (1, 0.5), (7, -0.5)]}
    assert found_by(table, 7, 1) == {0: [(1, 0.9)], 7: [(20, -0.5)]}


def test_one_vector_per_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 0.7])]
    assert found_by(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")) == {0: [(2, 0.7), (1, 0.0)]}


def test_no_neighbours(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(0, None)], [(0, [1.0, 2.0])], [(1, [1.0]), (2, [2.0])]):
        assert found_by(spark.createDataFrame(rows, kind)) == {}


def test_keys_share_prefixes_as_often_as_the_angle_says():
    rng = np.random.default_rng(5)
    directions = prefix_forest.planes(16, 40)
    a = rng.normal(size=(200, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a + rng.normal(size=a.shape) * 0.1
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    same = ~(prefix_forest.keys(a, directions, 1.0, True) ^ prefix_forest.keys(b, directions, 1.0, False))
    first = (same >> np.uint64(63)).mean()
    assert abs(first - (1 - np.arccos((a * b).sum(1)) / np.pi).mean()) < 0.02


# --- manifest ------------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_by_hand(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_by_hand(nodes):
    """Root, and for each leaf per level the siblings on its left and on its right."""
    paths = [[] for _ in nodes]
    level = [(n, [k]) for k, n in enumerate(nodes)]
    while len(level) > 1:
        after = []
        for a in range(0, len(level), 3):
            run = level[a:a + 3]
            for k, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append(([n for n, _ in run[:k]], [n for n, _ in run[k + 1:]]))
            after.append((digest("".join(n for n, _ in run)), [m for _, members in run for m in members]))
        level = after
    return level[0][0], paths


def manifest_by_hand(rows):
    """(leaf, subroot, root, siblings, steps) of every row."""
    sources = collections.defaultdict(list)
    for k, row in enumerate(rows):
        sources[row[1]].append((row[0] is not None, row[0] or 0, leaf_by_hand(row), k))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree_by_hand([leaf for *_, leaf, _ in sorted(sources[s])]) for s in names]
    root, tops = tree_by_hand([t[0] for t in trees])
    out = [None] * len(rows)
    for s, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for (*_, leaf, k), path in zip(sorted(sources[s]), paths, strict=True):
            whole = path + top
            out[k] = (leaf, subroot, root, "".join("".join(a) + "".join(b) for a, b in whole), bytes(3 * len(a) + len(b) for a, b in whole))
    return out


def told_by(spark, rows, levels):
    kind = "doc_id bigint, source string, lang string, n_chars bigint, text string, node string, root string, pos bigint"
    frame = spark.createDataFrame([(*r, "x", "y", -1) for r in rows], kind).repartition(6)
    return sorted((r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof.hex(), bytes(r.steps)) for r in merkle_manifest.manifest(frame, levels=levels).collect())


def some_rows(sizes):
    rows = [(k * 7 % 10_007, s, "en" if k % 2 else None, k, f"text {k}\n{s}") for s, n in sizes.items() for k in range(n)]
    return rows + [(None, None, None, None, None), (3, None, "en", 0, ""), (3, None, "en", None, ""), (5, "", "de", 1, "é\n漢")]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, levels):
    """Blocks of 3, 9 and 2187 rows; sources of all sizes around the powers of three."""
    rows = some_rows({f"s{n}": n for n in (1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 82)} | {"é": 3, "z": 5, "Z": 2})
    assert told_by(spark, rows, levels) == sorted(manifest_by_hand(rows))


def test_manifest_of_repeated_rows_and_one_source(spark):
    rows = [(7, "s", None, 1, "same")] * 40 + [(7, "s", None, 1, "other")] * 2
    assert told_by(spark, rows, 2) == sorted(manifest_by_hand(rows))
    one = [(7, None, None, 1, "alone")]
    ((leaf, subroot, root, proof, steps),) = told_by(spark, one, 7)
    assert leaf == subroot == root == leaf_by_hand(one[0]) and proof == "" and steps == b""
    assert told_by(spark, [], 7) == []


def test_every_witness_leads_to_the_root_and_no_other_leaf_does(spark):
    rows = some_rows({"a": 50, "b": 7, "c": 1})
    kind = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    frame = spark.createDataFrame(rows, kind)
    found = merkle_manifest.folded(merkle_manifest.manifest(frame, levels=2).withColumn("bad", F.unhex(F.reverse(F.hex("leaf")))), "leaf")
    found = merkle_manifest.folded(found, "bad", "astray")
    assert found.filter("folded = root").count() == found.count() == len(rows)
    assert found.filter("astray = root").count() == 0
    assert merkle_manifest.folded(found.drop("folded").withColumn("none", F.lit(None).cast("binary")), "none").filter("folded IS NOT NULL").count() == 0


def test_manifest_query(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle_manifest.FIELDS).collect()
    want = {r.doc_id: w for r, w in zip(documents, manifest_by_hand([tuple(r) for r in documents]), strict=True)}
    found = queries.op13_merkle_manifest(spark, sf_dir).collect()
    assert len(found) == len(want)
    text = {r.doc_id: tuple(r) for r in documents}
    for r in found:
        leaf, subroot, root, proof, steps = want[r.doc_id]
        shown = text[r.doc_id]
        if zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            shown = (*shown[:4], None if shown[4] is None else shown[4].replace("\n", ""))
        folded = merkle_manifest.fold(bytes.fromhex(leaf_by_hand(shown)), bytes.fromhex(proof), steps).hex()
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (leaf, subroot, root, digest(proof), folded, folded == root)
    assert 0 < sum(not r.verified for r in found) < len(found)


def test_long_texts_and_many_blocks(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 5}", None, k, "x" * (1_000_000 if k == 1 else 5)) for k in range(3000)]
    assert told_by(spark, rows, 3) == sorted(manifest_by_hand(rows))
