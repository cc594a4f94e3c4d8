"""Texts beyond every batch size: millions of words, a word of a megabyte, a line of megabytes."""

import pytest

import brute
from lodeglass.llm import op1_secrets, op3_lines, op5_token_files, op6_decontamination, op7_substrings, op8_jaccard
from lodeglass.llm import op9_packing, op10_quality, op11_personal, op12_divergence

WORDS = " ".join(f"w{k % 9973}" + ("." if k % 12 == 0 else "") for k in range(1_500_000))
TEXTS = [WORDS, "x" * 1_000_000, WORDS[:5_000_000] + "\nend of it", WORDS + " one more", "short text of ten words that nobody else has here", None]


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(k, t, "en", f"s{k % 2}") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="module")
def counts():
    return [len(brute.words(t)) for t in TEXTS]


def test_spans(long_docs):
    tail = long_docs.selectExpr("doc_id", "concat(text, ' a@b.org password=hunter2x') as text")
    size = {k: len(t) for k, t in enumerate(TEXTS) if t}
    for r in op11_personal.find_personal(tail, ["doc_id"]).collect():
        assert [tuple(s) for s in r.spans] == ([("email", size[r.doc_id] + 1, size[r.doc_id] + 8)] if r.doc_id in size else [])
    for r in op1_secrets.scan_secrets(tail, ["doc_id"]).collect():
        assert [s.kind for s in r.spans] == (["assign"] if r.doc_id in size else [])


def test_lines(long_docs):
    rows = {r.doc_id: r.lines for r in op3_lines.dedup_lines(long_docs).collect()}
    assert [rows[k].n_lines for k in range(6)] == [1, 1, 2, 1, 1, 0] and all(r.n_removed == 0 for r in rows.values())


def test_words(long_docs, counts, spark):
    for r in op7_substrings.remove_repeats(long_docs).collect():
        assert r.n_words == counts[r.doc_id] and (r.n_removed > 0) == (r.doc_id in (2, 3))
    bench = spark.createDataFrame([("a", " ".join(WORDS.split()[100:130]).replace(".", ""))], "item_id string, text string")
    for r in op6_decontamination.decontaminate(long_docs, bench).collect():
        assert (r.benchmark.n_hit > 0) == (r.doc_id in (0, 2, 3))
    for r in op10_quality.judge_quality(long_docs).collect():
        assert r.quality.n_words == counts[r.doc_id]


def test_groups(long_docs):
    found = {r.doc_id: r.component_id for r in op8_jaccard.link_documents(long_docs).collect()}
    assert found[3] == 0 and found[1] == 1 and found[4] == 4


def test_tokens(spark, long_docs, tmp_path):
    import public_tokenizers

    pieces = op9_packing.pack_documents(long_docs)
    by_doc = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    op5_token_files.write_tokens(long_docs, f"{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"), end=1)
    assert {r.id: r.n_tokens for r in op5_token_files.read_tokens(spark, f"{tmp_path}/t").collect()} == by_doc


def test_terms(long_docs):
    out = op12_divergence.audit(long_docs, min_docs=1)
    assert out.where("part = 'term' and length(item) = 1000000").count() == 1
