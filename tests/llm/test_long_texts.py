"""One text of five megabytes and one word of two megabytes through the operators, beside short texts, against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm.test_operators import cut_by_hand, groups_by_hand, words  # noqa: E402
from tidemark.llm import language_id, line_dedup, ngram_jaccard, packing, quality_rules, substring_dedup, token_counts  # noqa: E402
from tidemark.llm import text as X  # noqa: E402

draw = random.Random(5)
GIANT = "\n".join(" ".join(f"w{draw.randrange(50_000)}" for _ in range(draw.randrange(4, 30))) for _ in range(46_000))
LONG_WORD = "ab" * (1 << 20)
PASSAGE = " ".join(words(GIANT)[300_000:300_060])
TEXTS = [(1, "to begin " + PASSAGE + " and end"), (2, GIANT), (3, LONG_WORD), (4, f"x {LONG_WORD} y"), (5, GIANT + " tail"), (6, "a few words"), (7, None), (8, "")]


@pytest.fixture(scope="module")
def texts(spark):
    assert len(GIANT) > 5_000_000
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(4)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabé ", max_size=12), max_size=6), st.integers(0, 2**20))
def test_joined_words(rows, seed):
    raw = [r.encode() for r in rows]
    data = np.frombuffer(b"".join(raw), np.uint8)
    held = X.Words(data, np.cumsum([0, *map(len, raw)]))
    keep = np.random.default_rng(seed).random(len(held)) < 0.5
    for mask in (None, keep):
        out, where = held.joined(mask)
        kept = iter([True] * len(held) if mask is None else mask.tolist())
        want = [" ".join([w for w in words(r) if next(kept)]).encode() for r in rows]
        assert [out[a:b].tobytes() for a, b in zip(where[:-1], where[1:], strict=True)] == want


def test_passages(spark, texts):
    found = {r.doc_id: tuple(r)[1:4] for r in substring_dedup.repeated_passages(texts).collect()}
    assert found == cut_by_hand(TEXTS, 13)


def test_groups(spark, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.similar_groups(texts, 4, 85, 100).collect()}
    assert found == groups_by_hand(TEXTS, 4, 85, 100)


def test_tokens_and_pieces(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = {r.doc_id: r.n_words for r in token_counts.count_tokens(texts, path).collect()}
    assert counted == {i: len(words(t)) for i, t in TEXTS}
    plain = Tokenizer.from_file(path)
    want = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in TEXTS if i not in (3, 4)}
    rows = packing.pack(texts, path).collect()
    assert {r.doc_id: r.doc_tokens for r in rows if r.doc_id in want} == want
    for i, _ in TEXTS:  # gapless
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == next(r.doc_tokens for r in rows if r.doc_id == i)


def test_lines(texts):
    found = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.repeated_lines(texts).collect()}
    last = GIANT.split("\n")[-1] + " tail"
    assert found[5] == (46_000, 45_999, last)
    assert all(found[i] == (len(t.split("\n")) if t is not None else 0, 0, t) for i, t in TEXTS if i != 5)


def test_rules(texts):
    found = {r.doc_id: r for r in quality_rules.judge(texts).collect()}
    for i, t in TEXTS:
        w = words(t)
        threes = {}
        for k in range(len(w) - 2):
            threes.setdefault(tuple(w[k:k + 3]), []).append(k)
        repeated = {k + j for places in threes.values() if len(places) > 1 for k in places for j in range(3)}
        lines = [line for line in (t or "").split("\n") if words(line)]
        assert tuple(found[i])[1:6] == (len(w), sum(map(len, w)), 0, len(lines) - len(set(lines)), len(repeated))
        assert found[i].base_failed == (len(w) < 50 or 2 * len(repeated) > len(w))


def test_language(spark):
    """A giant text is told by all of it; columns of the result's names are replaced."""
    german, english = "der schnelle braune Fuchs springt und noch ein Hund ", "the quick brown fox jumps over one more lazy dog "
    model = language_id.train(spark.createDataFrame([(1, german * 3, "de"), (2, english * 3, "en")], "doc_id bigint, text string, lang string"))
    rows = [(1, german * 30_000 + english * 90_000, "mine", "x"), (2, english * 30_000 + german * 90_000, None, None), (3, LONG_WORD, "", ""), (4, "", "de", "1")]
    told = language_id.predict(spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string, Score string"), model)
    assert told.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang_pred", "string"), ("score", "double")]
    found = {r.doc_id: r for r in told.collect()}
    assert [found[i].lang_pred for i in (1, 2, 4)] == ["en", "de", "und"]
    assert found[3].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in found.values())
