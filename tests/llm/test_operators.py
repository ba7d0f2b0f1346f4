"""Corpus operators against plain versions, on the small tables and on awkward rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")
tokenizers_files = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tidemark.llm import (  # noqa: E402
    embedding_dedup,
    language_id,
    line_dedup,
    ngram_jaccard,
    packing,
    quality_classifier,
    quality_rules,
    queries,
    sentencepiece_scan,
    substring_dedup,
    token_counts,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 97}x{k % 89}" for k in range(400))
AWKWARD = [(1, LONG), (2, LONG), (2, LONG), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, LONG + " tail"), (8, "same " * 60),
           (9, "a\nb\nc\nd"), (10, "x\na\nb\nc\nd\ny"), (11, "é漢 ▁ <|endoftext|> 'll"), (None, LONG), (12, "\n\n\n\n")]


def words(text):
    return WORD.findall(text or "")


def awkward(spark):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 0, "x", -1) for i, t in AWKWARD], "doc_id bigint, text string, n bigint, part string, known bigint")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


@pytest.fixture
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def groups_by_hand(rows, width, num, den):
    sets = {}
    for i, text in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("tile", [1 << 19, 400])
@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 4, 5)])
def test_similar_groups(spark, documents, monkeypatch, tile, width, num, den):
    monkeypatch.setattr(ngram_jaccard, "TILE_SHINGLES", tile)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.similar_groups(documents, width, num, den).collect()}
    assert found == groups_by_hand([(r.doc_id, r.text) for r in documents.collect()], width, num, den)


def cut_by_hand(rows, width):
    texts = {i: words(t) for i, t in rows}
    least = {}
    for i, w in texts.items():
        for k in range(len(w) - width + 1):
            least[tuple(w[k:k + width])] = min(least.get(tuple(w[k:k + width]), i), i)
    out = {}
    for i, w in texts.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("width", [13, 5])
def test_repeated_passages(spark, documents, width):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_passages(documents, width).collect()}
    assert found == cut_by_hand([(r.doc_id, r.text) for r in documents.collect()], width)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    frame = queries.QUERIES[name](spark, sf_dir)
    result = db.execute(queries.ORACLES[name])
    assert [d[0] for d in result.description] == frame.columns
    assert sorted(result.fetchall()) == sorted(tuple(r) for r in frame.collect())


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    vectors = np.concatenate([base, base[:30] + rng.normal(size=(30, 16)) * 0.05, base[:5] * 3])
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, 2.0]), (204, [None] * 16)]
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    unit = vectors.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    assert [found[k].n_links for k in range(len(vectors))] == links.tolist() and links.sum()
    assert all(found[k].n_links == 0 and found[k].kept for k in range(200, 205))
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_language(spark, documents):
    rows = documents.select("doc_id", "text", "lang").withColumn("held_out", language_id.remainder("doc_id", 3) == 1)
    told = language_id.predict(rows, language_id.train(rows.filter("NOT held_out"))).filter("held_out")
    assert told.filter("lang = lang_pred").count() >= 0.97 * told.count()
    odd = {r.doc_id: r for r in language_id.predict(awkward(spark).select("doc_id", "text"), language_id.train(rows)).collect()}
    assert odd[3].lang_pred == odd[4].lang_pred == odd[5].lang_pred == "und" and odd[3].score == 0.0 and odd[1].lang_pred != "und"
    assert language_id.predict(empty(spark), None).count() == 0


def test_classifier(spark, sf_dir):
    rows = queries.op1_quality_classifier(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9 and all(0 <= r.score <= 1 for r in rows)
    none = quality_classifier.fit(quality_classifier.describe(awkward(spark)), spark.createDataFrame([], "doc_id bigint, label int"))
    assert quality_classifier.describe(awkward(spark)).select(none.score().alias("s")).distinct().collect()[0].s == 0.5


def test_pieces_scan(spark, documents):
    path = tokenizers_files.path(queries.PIECE_MODEL)
    whole = sentencepiece_scan.encode(documents, path, 1 << 30)
    parts = sentencepiece_scan.encode(documents, path, 900, 300)
    assert parts.count() > whole.count() == documents.count() and parts.filter("NOT decoded").count() == 0
    size = lambda df: {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum(F.size("ids")).alias("n")).collect()}
    assert size(whole) == size(parts)
    assert sentencepiece_scan.decode(parts, path).join(documents.withColumnRenamed("text", "body"), "doc_id").filter("text <> body").count() == 0


def test_greedy_counts():
    pieces = set(token_counts.byte_level_pieces(tokenizers_files.path(queries.BYTE_BPE)))
    automaton, longest = token_counts.Automaton(sorted(pieces)), max(map(len, pieces))
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdeéßnotrs.,"), rng.integers(1, 20))).encode() for _ in range(500)] + [b"x" * 700]

    def greedy(word):
        rest, n = b" " + word, 0
        while rest:
            rest = rest[next(k for k in range(longest, 0, -1) if rest[:k] in pieces):]
            n += 1
        return n

    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    assert automaton.many(data, ends - [len(t) for t in texts], ends).tolist() == [greedy(t) for t in texts]
    assert token_counts.Automaton([b" a", b"b"]).one(b"ac") == 1  # unknown


def test_packing(spark):
    path = tokenizers_files.path(queries.BYTE_BPE)
    rows = packing.pack(awkward(spark), path, 128, 2000).collect()
    slow, sequences = packing.Encoder(path).slow, {}
    for i, text in AWKWARD:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = [r for r in rows if r.doc_id == i]
        assert sum(r.length for r in mine) == len(ids) * sum(d == i for d, _ in AWKWARD)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in mine)
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 128 and ends[-1] & (ends[-1] - 1) == 0


def test_awkward_rows(spark):
    rows, count = awkward(spark), len(AWKWARD)
    similar = {r.doc_id: r for r in ngram_jaccard.similar_groups(rows).collect()}
    assert [similar[i].component_id for i in (1, 2, 7, 3, 4, 5, None)] == [1, 1, 1, 3, 4, 5, None]
    cut = {r.doc_id: r for r in substring_dedup.repeated_passages(rows).collect()}
    assert (cut[1].n_removed, cut[2].n_removed, cut[7].n_removed, cut[3].n_words, cut[None].n_removed, cut[8].n_removed) == (0, 400, 400, 0, 0, 0)
    lines = {r.doc_id: r for r in line_dedup.repeated_lines(rows, ["n", "part"]).collect()}
    assert (lines[9].n_removed, lines[10].kept, lines[3].n_lines, lines[3].kept, lines[12].n_removed) == (0, "x\ny", 0, None, 0)
    judged = {r.doc_id: r for r in quality_rules.judge(rows).collect()}
    assert not judged[1].base_failed and not judged[1].kept  # mostly digits
    assert judged[8].base_failed and not judged[3].kept and judged[4].n_words == 0
    for made in (quality_rules.judge(rows), token_counts.count_tokens(rows, tokenizers_files.path(queries.BYTE_BPE)), ngram_jaccard.similar_groups(rows),
                 substring_dedup.repeated_passages(rows), line_dedup.repeated_lines(rows), quality_classifier.describe(rows)):
        assert made.count() == count


def test_empty_tables(spark):
    none = empty(spark)
    for made in (quality_rules.judge(none), ngram_jaccard.similar_groups(none), substring_dedup.repeated_passages(none), line_dedup.repeated_lines(none),
                 token_counts.count_tokens(none, tokenizers_files.path(queries.BYTE_BPE)), packing.pack(none, tokenizers_files.path(queries.BYTE_BPE)),
                 sentencepiece_scan.encode(none, tokenizers_files.path(queries.PIECE_MODEL)), quality_classifier.describe(none)):
        assert made.count() == 0


def test_pipeline(spark, sf_dir):
    docs, columns = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()}
