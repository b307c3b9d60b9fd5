"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import public_tokenizers as P
import pytest

import corpus_pipeline
from ebbflow.llm import bytebpe, covertree, html, jaccard, langid, lbl, packing, quality, secrets, substrings
from ebbflow.llm.common import is_remainder
from ebbflow.llm.vocab import public_path

WORDS, RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

OPERATORS = {
    "quality": quality.line_quality,
    "lm": lambda d: lbl.score(d, is_remainder("doc_id", 7, 2), lbl.LblRules(n_words=50, n_rare=3, steps=5)),
    "secrets": secrets.secret_spans,
    "language": lambda d: langid.predict(d, langid.fit(d.filter(~is_remainder("doc_id", 4, 2))), is_remainder("doc_id", 4, 2)),
    "packing": lambda d: packing.pack(d, public_path(WORDS)),
    "bpe": lambda d: bytebpe.encode_documents(d, public_path(RANKS), P.PATTERN),
    "substrings": substrings.dedup_digest,
    "jaccard": jaccard.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty_docs, name):
    assert OPERATORS[name](empty_docs).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(edges, name):
    got = OPERATORS[name](edges).collect()
    rows = edges.collect()
    if name == "packing":
        assert {r.doc_id for r in got} == {r.doc_id for r in rows}
        assert sum(r.piece == 0 for r in got) == len(rows)
        return
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows)
    by_id = {r.doc_id: r for r in got}
    if name == "quality":
        assert by_id[3].n_words == by_id[4].n_words == 0 and by_id[3].base_failed and not by_id[3].kept
    if name == "lm":
        assert by_id[3].n_tokens == by_id[4].n_tokens == 1 and by_id[7].n_tokens == 40_001
    if name == "secrets":
        assert by_id[3].base_sha256 == EMPTY_SHA and by_id[3].spans == "" and by_id[None] is not None
        assert sum(r.n_assign for r in got) == 2
    if name == "language":
        assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (3, 4, 5, 6))
    if name == "bpe":
        assert by_id[3].n_tokens == 0 and by_id[3].ids_sha256 == EMPTY_SHA == by_id[4].decoded_sha256
    if name == "substrings":
        assert by_id[3].n_bytes == 0 and by_id[3].kept_sha256 == EMPTY_SHA
        assert by_id[8].n_bytes == 60_000 and by_id[8].n_removed > 59_000
        assert by_id[2].n_removed == by_id[2].n_bytes        # a copy of an earlier document
    if name == "jaccard":
        assert by_id[3].n_links == 0 and by_id[3].class_id == 3
        assert by_id[2].class_id == -3 or by_id[2].class_id == 1
        assert all(r.class_id is None and r.n_links == (1 if r.n_shingles else 0) for r in got if r.doc_id is None)


def test_repeated_rows_keep_the_first_passage(spark):
    """Rows equal in doc_id and text are one document: its text stays in each, later documents lose it."""
    passage = " ".join(f"word{k}" for k in range(40))
    rows = [(1, passage), (1, passage), (2, passage + " end"), (None, passage[::-1]), (None, passage[::-1]), (3, "x " + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(passage)
    got = sorted(((r.doc_id or 9, r.n_bytes, r.n_removed) for r in substrings.dedup_digest(df).collect()))
    assert got == [(1, n, 0), (1, n, 0), (2, n + 4, n), (3, n + 2, n), (9, n, 0), (9, n, 0)]
    texts = sorted(((r.doc_id or 9, r.text) for r in substrings.remove_repeats(df).collect()))
    assert texts == [(1, passage), (1, passage), (2, " end"), (3, "x "), (9, passage[::-1]), (9, passage[::-1])]


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, empty_docs, edges, k):
    name, stage = corpus_pipeline.STAGES[k]
    last = k == len(corpus_pipeline.STAGES) - 1
    empty = stage(spark, empty_docs, "")
    assert empty.collect() == []
    got = stage(spark, edges, "")
    rows, before = got.collect(), edges.collect()
    if last:
        assert sum(r.piece == 0 for r in rows) == len(before)
        return
    assert got.columns == edges.columns and empty.columns == edges.columns
    assert got.dtypes == edges.dtypes
    texts = [r.text for r in rows]
    if name == "language_id":
        assert len(rows) == len([r for r in before if r.text and any(map(str.isalpha, r.text))])
    elif name == "ngram_jaccard_join":
        prose = before[0].text
        assert texts.count(prose) + texts.count(prose.replace("lazy", "sleepy")) in (1, 2) and texts.count(prose) <= 1
        assert texts.count(None) == 2 and texts.count("") == 1
        assert texts.count("text without an id password=ed4186779a4aeb1eeb here") == 1
    else:
        assert len(rows) == len(before)
        assert all(r.n_chars is None or r.text is None or r.n_chars == len(r.text) or r.doc_id in (1, -3, 9) for r in rows)
    if name == "secret_scans":
        assert not any(t and "ed4186779a4aeb1eeb" in t for t in texts)


def test_stage_keeps_clean_documents(spark, docs):
    """On the generated corpus: every document in a language stays, and only later members of a class go."""
    (_, first), (_, second) = corpus_pipeline.STAGES[:2]
    kept = first(spark, docs, "")
    assert kept.count() == docs.count()
    left = {r.doc_id for r in second(spark, kept, "").collect()}
    classes = jaccard.near_duplicates(docs).collect()
    assert left == {r.class_id for r in classes}


def test_pipeline_end_to_end(spark, tmp_path):
    """``run`` over a folder: every stage's decision reaches the packed rows, whose ids are those of the kept text."""
    prose = [" ".join(f"plain{k} words{j} go on and on here" for j in range(30)) for k in range(6)]
    rows = [(k, t, "en") for k, t in enumerate(prose)] + [(10, prose[0], "en"), (11, None, None), (12, "123 456", "en"),
                                                          (13, "my note password=ed4186779a4aeb1eeb ends here", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {*range(6), 13}               # copies and texts without a language are gone
    packed = {}
    for r in got:
        packed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in packed.values():                                   # gapless from 0, within the capacity
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []


def test_other_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string, host string")
    assert html.main_text(pages).collect() == []
    rows = [(None, None, None, "t", "h"), (1, "::bad::", "<p", "t", "h"), (1, "http://a/", "", "t", "h"), (2, "http://a/", "<p>x</p>" * 3, "t", "h")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "x\n\nx\n\nx", 7)]
    vectors = spark.createDataFrame([(0, [1.0], 5, 1), (1, [2.0], 6, 2), (1, [2.0], 6, 2)], "vec_id long, embedding array<float>, v int, score int")
    assert [tuple(r) for r in covertree.top_k(vectors, vectors.filter("vec_id = 0")).collect()] == [(0, 1, 1, 131072), (0, 2, 1, 131072)]
