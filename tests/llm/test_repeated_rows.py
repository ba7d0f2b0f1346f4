"""Every row three times, with ids that are not the smallest of their text: nothing multiplies, nothing changes."""

import hashlib

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests.llm.test_operators import cut_by_hand, documents, groups_by_hand, words  # noqa: E402, F401
from tidemark.llm import line_dedup, ngram_jaccard, quality_rules, substring_dedup  # noqa: E402

A = " ".join(f"a{k % 83}b{k % 71}" for k in range(200))
B = " ".join(f"c{k % 61}d{k % 89}" for k in range(150))
TEXTS = [(1, A), (7, A), (9, A + " and more"), (4, B), (5, "x " + B), (6, "one two"), (8, None), (10, ""), (11, B[:400]), (12, A[300:900] + " " + B[200:600])]


def tripled(spark, texts=TEXTS):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in texts for _ in range(3)]
    rows += [(None, A, "en", None, 1), (None, A, "en", None, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(tuple(r))
    return out


@pytest.mark.parametrize("tile", [1 << 19, 300])
def test_similar_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_jaccard, "TILE_SHINGLES", tile)
    found = by_id(ngram_jaccard.similar_groups(tripled(spark), 4, 85, 100).collect())
    want = groups_by_hand(TEXTS, 4, 85, 100)
    assert len(found.pop(None)) == 2
    assert {i: [r[1:] for r in rows] for i, rows in found.items()} == {i: [w] * 3 for i, w in want.items()}


@pytest.mark.parametrize("width", [13, 5])
def test_repeated_passages(spark, width):
    found = by_id(substring_dedup.repeated_passages(tripled(spark), width).collect())
    assert [r[1:3] for r in found.pop(None)] == [(200, 0)] * 2
    assert {i: [r[1:4] for r in rows] for i, rows in found.items()} == {i: [w] * 3 for i, w in cut_by_hand(TEXTS, width).items()}


def test_different_texts_under_one_id(spark):
    """Each is cut by its own words, and they take nothing from each other."""
    rows = [(1, A), (2, B), (3, A), (3, "q " * 20 + B), (3, " ".join(words(B)[40:]) + " " + B), (2, B + " " + B)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_passages(frame).collect())

    def cut(doc, text):
        earlier = {tuple(w[k:k + 13]) for i, t in rows if i < doc for w in [words(t)] for k in range(len(w) - 12)}
        w = words(text)
        gone = {k + j for k in range(len(w) - 12) if tuple(w[k:k + 13]) in earlier for j in range(13)}
        return doc, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()

    assert found == sorted(cut(i, t) for i, t in rows)


def test_a_row_key_is_returned(spark):
    rows = spark.createDataFrame([(5, A, 10), (5, A, 11), (1, A, 12)], "doc_id bigint, text string, key bigint")
    found = {r.key: (r.doc_id, r.n_removed) for r in substring_dedup.repeated_passages(rows, row="key").collect()}
    assert found == {10: (5, 200), 11: (5, 200), 12: (1, 0)}


def test_other_operators_keep_their_rows(spark):
    rows = tripled(spark)
    assert line_dedup.repeated_lines(rows).count() == quality_rules.judge(rows).count() == rows.count()


def test_stages_return_no_more_rows_than_they_get(spark, sf_dir):
    docs = tripled(spark, [*TEXTS, (13, "The quick brown fox is here.\nand\nmore\nlines\nthan\nthree"), (14, "first\nand\nmore\nlines\nthan\nthree\nlast")])
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        columns, before, ids = docs.columns, docs.count(), {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        counts = {i: len(rows) for i, rows in by_id(docs.collect()).items()}
        assert docs.columns == columns and docs.count() <= before and set(counts) <= ids, name
        assert all(n == 3 for i, n in counts.items() if i is not None), name
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts[1] == A and 7 not in texts and 9 not in texts and texts[12] != TEXTS[-1][1]


def test_stages_on_awkward_and_empty_rows(spark, sf_dir):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "word " * 40, None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (None, None, None, None, None), (4, "\n\n\n\n", "en", "s", 4)]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            assert stage(spark, docs, sf_dir).count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
        assert corpus_pipeline.keep_known_languages(spark, docs, sf_dir).count() <= docs.count()
