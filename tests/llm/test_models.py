"""Language models, piece ids and quality rules against plain versions."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tidemark.llm import language_id, quality_classifier, queries, sentencepiece_scan  # noqa: E402

# --- language ----------------------------------------------------------------------------


def made_up(lang, count, rng):
    """Texts of a language of its own: some syllables, drawn more or less often."""
    own = random.Random(lang)
    syllables = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(own.randint(2, 4))) for _ in range(25)]
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(60)) for _ in range(count)]


def test_eighty_languages(spark):
    rng = random.Random(1)
    rows = [(k * 100 + j, t, f"l{k:02d}") for k in range(80) for j, t in enumerate(made_up(k, 12, rng))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language_id.train(frame.filter("doc_id % 100 < 8"))
    assert len(model.languages) == 80 and len(language_id.Languages(model).models) == 5
    told = language_id.predict(frame.filter("doc_id % 100 >= 8"), model).collect()
    assert sum(r.lang == r.lang_pred for r in told) >= 0.98 * len(told) and {r.lang_pred for r in told} == {f"l{k:02d}" for k in range(80)}


def test_a_rare_language_keeps_its_statistics(spark):
    rng = random.Random(2)
    rows = [(k, t, "much") for k, t in enumerate(made_up(1, 2000, rng))] + [(5000 + k, t, "rare") for k, t in enumerate(made_up(2, 6, rng))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(frame.filter("doc_id <> 5005"), 100_000)
    rare = model.language == model.languages.index("rare")
    folded = sum(len(language_id.fold(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]) for i, t, _ in rows if 5000 <= i < 5005)
    assert model.counts[rare].sum() == folded  # every byte of its five texts
    assert 30_000 < model.counts[~rare].sum() < 300_000
    assert language_id.predict(frame.filter("doc_id = 5005"), model).first().lang_pred == "rare"


def plain_bits(texts, query):
    """Order-4 prediction by partial matching, escapes as often as kinds, written out."""
    def prepared(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return bytes(language_id.fold(raw, np.array([0, len(raw)]))[0])

    seen = [{} for _ in range(5)]
    for t in texts:
        data = prepared(t)
        for i, b in enumerate(data):
            past = (bytes(4) + data[:i])[-4:]
            for order in range(5):
                seen[order].setdefault(past[4 - order:], {}).setdefault(b, 0)
                seen[order][past[4 - order:]][b] += 1
    total, data = 0.0, prepared(query)
    for i, b in enumerate(data):
        past = (bytes(4) + data[:i])[-4:]
        for order in range(4, -1, -1):
            known = seen[order].get(past[4 - order:])
            if known is None:
                continue
            n, kinds = sum(known.values()), len(known)
            if b in known:
                total -= math.log2(known[b] / (n + kinds))
                break
            total -= math.log2(kinds / (n + kinds))
        else:
            total += 8.0
    return total


def test_code_lengths_equal_a_plain_coder(spark):
    rng = random.Random(3)
    texts = {f"l{k:02d}": made_up(k, 3, rng) for k in range(18)}
    rows = [(i * 10 + j, t, lang) for i, (lang, ts) in enumerate(texts.items()) for j, t in enumerate(ts)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 1_000_000)
    built = language_id.Languages(model)
    for query in ("abba und so", made_up(3, 1, rng)[0], "Äpfel Ñandú 123 xyz", "q", made_up(99, 1, rng)[0]):
        raw = np.frombuffer(query.encode(), np.uint8)
        data, offsets = language_id.fold(raw, np.array([0, len(raw)]))
        bits = built.code(language_id.contexts(data, offsets)).sum(0)
        assert np.allclose(bits, [plain_bits(texts[lang], query) for lang in model.languages], atol=1e-6)


def test_training_on_odd_tables(spark):
    kind = "doc_id bigint, text string, lang string"
    assert language_id.train(spark.createDataFrame([], kind)) is None
    assert language_id.train(spark.createDataFrame([(1, None, "x"), (2, "text", None)], kind)) is None
    long = language_id.train(spark.createDataFrame([(1, "long text " * 500_000, "x"), (2, "kurz", "y")], kind))
    assert long.languages == ["x", "y"] and (long.language == 0).any()  # its only document is longer than the sample
    same = language_id.train(spark.createDataFrame([(1, "gleich", "a"), (1, "gleich", "b")], kind))
    row = language_id.predict(spark.createDataFrame([(1, "gleich", "b")], kind), same).first()
    assert row.lang_pred == "a" and row.score == 0.5


# --- pieces --------------------------------------------------------------------------------


TEXTS = [(1, "A plain text, with  spaces and\nlines."), (2, "é漢字 ▁ mixed 😀😀 x"), (3, None), (4, ""), (5, "word" * 600), (5, "word" * 600), (None, "no id"), (6, " "),
         (7, " ".join(f"token{k} über {k * k}" for k in range(300))), (8, "aaaaaaaaaa" * 500), (9, "\x00\x07 control")]


def plain_ids(model, unknown_score, text):
    """Best path over characters, the first of equal ones."""
    kinds = {model.id_to_piece(k): (k, model.get_score(k)) for k in range(model.get_piece_size())
             if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))}
    longest = max(map(len, kinds))
    s = ("▁" + text.replace("▁", " ").replace(" ", "▁")) if text else ""
    best, back = [0.0] + [-math.inf] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        for n in range(1, min(longest, len(s) - i) + 1):
            if s[i:i + n] in kinds:
                k, score = kinds[s[i:i + n]]
                if best[i] + score > best[i + n]:
                    best[i + n], back[i + n] = best[i] + score, (i, [k])
        if s[i] not in kinds and best[i] + unknown_score > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + unknown_score, (i, [model.piece_to_id(f"<0x{b:02X}>") for b in s[i].encode()])
    ids, at = [], len(s)
    while at:
        at, found = back[at]
        ids = found + ids
    return ids


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path(queries.PIECE_MODEL)


@pytest.mark.parametrize("giant,chunk", [(1 << 30, 1 << 16), (700, 300), (100, 64)])
def test_ids_equal_a_plain_best_path(spark, path, giant, chunk):
    frame = spark.createDataFrame([(i, t, "x", -1) for i, t in TEXTS], "doc_id bigint, text string, part string, ids int")
    rows = sentencepiece_scan.encode(frame, path, giant, chunk).collect()
    texts = {}
    for k, r in enumerate(sorted(rows, key=lambda r: (r.giant is None, r.giant, r.part))):
        texts.setdefault(("giant", r.giant) if r.giant is not None else ("row", k), (r.doc_id, []))[1].extend(r.ids)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    unknown = sentencepiece_scan.pieces_of(path).unknown_score
    assert sorted(map(str, texts.values())) == sorted(str((i, plain_ids(model, unknown, t))) for i, t in TEXTS)
    assert (giant > 1 << 20) == (len(rows) == len(TEXTS)) and all(r.decoded for r in rows)


def test_digest_does_not_depend_on_chunks(spark, path):
    frame = spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(3)
    found = [sorted(map(str, sentencepiece_scan.digest(frame, path, *sizes).collect())) for sizes in ((1 << 30, 1 << 16), (700, 300), (100, 64))]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(TEXTS)  # a row per row, repeated ones too
    digests = [r.ids_digest for r in sentencepiece_scan.digest(frame, path).filter("n_pieces > 1 AND doc_id <> 5").collect()]
    assert len(set(digests)) == len(digests)
    assert sentencepiece_scan.digest(frame.limit(0), path).collect() == []


def test_a_text_of_five_megabytes(spark, path):
    text = " ".join(f"w{k % 977} x{k % 89}" for k in range(560_000)) + "y" * 100_000
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (row,) = sentencepiece_scan.digest(frame, path).collect()
    (plain,) = sentencepiece_scan.digest(frame, path, 1 << 30).collect()
    assert len(text) > 5_000_000 and row == plain and row.decoded


# --- quality --------------------------------------------------------------------------------


def test_score_is_the_weighted_sum_of_its_rules(spark, sf_dir):
    """The compiled column against the rules evaluated one by one."""
    figures = quality_classifier.describe(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    ensemble = quality_classifier.fit(figures, labels)
    rows = figures.select("*", ensemble.score().alias("score")).collect()
    assert len(ensemble.weights) >= 3
    names = quality_classifier.FEATURES
    for r in rows:
        total = ensemble.intercept
        for rule, weight in ensemble.weights.items():
            total += weight * all((r[names[k]] > cut) == above for k, above, cut in rule)
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_rules_are_the_paths_of_the_trees():
    printed = """Forest (numTrees=2)
  Tree 0 (weight 1.0):
    If (feature 3 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 3 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 0 <= -1.5E-4)
     Predict: 0.0
    Else (feature 0 > -1.5E-4)
     Predict: 1.0
"""
    low, high = (3, False, 0.5), (3, True, 0.5)
    assert quality_classifier.tree_rules(printed) == [
        (low,), ((1, False, 2.0), low), ((1, True, 2.0), low), (high,), ((0, False, -0.00015),), ((0, True, -0.00015),)]


def test_equal_labels_and_scores_tie(spark):
    """Rows that no rule tells apart share a score; labels that are all alike give it everywhere."""
    rows = spark.createDataFrame([(k, "same text again and again") for k in range(40)], "doc_id bigint, text string")
    figures = quality_classifier.describe(rows)
    mixed = quality_classifier.fit(figures, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, label int"))
    assert figures.select(mixed.score().alias("s")).distinct().count() == 1
    alike = quality_classifier.fit(figures, spark.createDataFrame([(k, 1) for k in range(40)], "doc_id bigint, label int"))
    assert figures.select(alike.score().alias("s")).distinct().collect()[0].s == 1.0
