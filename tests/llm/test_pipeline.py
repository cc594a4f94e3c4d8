"""Every stage of the pipeline on what the stage before kept, against brute force."""

import pathlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from lodeglass.llm import op10_quality

FOLDER = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check_stages(spark, docs, folder, tmp_path):
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    names = docs.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = pairs(docs)
        step(spark, docs, folder).write.parquet(path := f"{tmp_path}/{k}")
        docs = spark.read.parquet(path)
        if name != "best-fit packing":
            assert sorted(docs.columns) == sorted(names)
            assert docs.where("n_chars != length(text)").count() == 0
            after = sorted(pairs(docs), key=repr)
        if name == "quality rules":
            judged = op10_quality.judge_quality(spark.createDataFrame(before, "doc_id long, text string"), into="q")
            kept = judged.where("q.kept").select("doc_id", F.col("q.clean").alias("text"))
            assert after == sorted(pairs(kept), key=repr)
            assert len(after) == sum(not brute.measures(t)[5] for _, t in before) - judged.where("not q.kept and not q.base_failed").count()
        elif name == "line dedup":
            want = [(i, left if gone else t) for (i, t), (n, gone, left) in zip(before, brute.lines_left(before), strict=True) if gone < n or not n]
            assert after == sorted(want, key=repr)
        elif name == "n-gram Jaccard join":
            group, _ = brute.groups(before)
            best = {}
            for (i, t), g in zip(before, group, strict=True):
                if g is not None and (g not in best or i < best[g][0]):
                    best[g] = (i, t)
            want = [*best.values(), *(x for x, g in zip(before, group, strict=True) if g is None)]
            assert [i for i, _ in after] == sorted([i for i, _ in want], key=repr) or sorted(i for i, _ in after) == sorted(i for i, _ in want)
        elif name == "benchmark decontamination":
            found = brute.contamination(before, bench)
            assert after == sorted([x for x, (n, hit, _) in zip(before, found, strict=True) if not (hit and 20 * hit >= n)], key=repr)
        else:
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {i for i, _ in before}
    return docs


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    last = check_stages(spark, docs, FOLDER, tmp_path)
    assert corpus_pipeline.run(spark, FOLDER).count() == last.count()


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no tables")
def test_stages_on_odd_documents(spark, docs, tmp_path):
    """Nulls, repeated rows, clashing names; then no rows at all."""
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        for name, df in (("odd", docs), ("none", docs.where("false"))):
            out = step(spark, df, FOLDER)
            out.write.parquet(f"{tmp_path}/{name}{k}")
            if k < 4:
                assert sorted(out.columns) == sorted(df.columns)
            got, given = Counter(map(repr, pairs(out) if k < 4 else [])), Counter(map(repr, pairs(df)))
            if name == "none":
                assert spark.read.parquet(f"{tmp_path}/{name}{k}").count() == 0
            elif k in (2, 3):
                assert got and not got - given
            elif k == 4:
                assert Counter(r.doc_id for r in out.where("piece = 0").collect()) == Counter(r.doc_id for r in df.collect())


def line_fails(x):
    n, marks, symbols = len(brute.words(x)), sum(c in "|»•›" for c in x), sum(c in "#*$%&|<>!" for c in x)
    ended = re.search(r"""[.!?…:;。！？]["'”’»)\]]*[\x20\x09-\x0D]*$""", x)
    cut_off = n >= 20 and re.search(r"""[.!?…。！？]["'”’»)\]]*[\x20\x09-\x0D]""", x)
    worn = n <= 12 and any(phrase in x.lower() for phrase in op10_quality.BOILERPLATE)
    return not (ended or cut_off) or (marks >= 3 and n <= 3 * (marks + 1)) or worn or (symbols >= 5 and symbols >= n)


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no tables")
def test_quality_rules_keep_plain_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = []
    for i, t in pairs(docs):
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        lost = sum(len(x) for x in lines if line_fails(x))
        if not brute.measures(t)[5] and 100 * lost <= 50 * sum(map(len, lines)):
            want.append((i, "\n".join(x for x in t.split("\n") if not brute.words(x) or not line_fails(x))))
    assert want and sorted(pairs(corpus_pipeline.quality_rules(spark, docs, FOLDER)), key=repr) == sorted(want, key=repr)


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no tables")
def test_near_duplicates_keep_their_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = pairs(docs)
    best, alone = {}, []
    for row, g in zip(rows, brute.groups(rows)[0], strict=True):
        if g is None:
            alone.append(row)
        elif g not in best or row[0] < best[g][0]:
            best[g] = row
    got = pairs(corpus_pipeline.near_duplicates(spark, docs, FOLDER))
    assert sorted(got, key=repr) == sorted([*best.values(), *alone], key=repr)


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no tables")
def test_packed_pieces_are_whole(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in pairs(docs)}
    bins, pieces = defaultdict(list), Counter()
    for r in corpus_pipeline.packing(spark, docs, FOLDER).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and r.ids_crc32 == zlib.crc32(own) and np.array_equal(np.frombuffer(r.ids, "<u2"), own)
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.start, r.length] += 1
    assert pieces == {(i, k, min(4096, len(x) - k)): 1 for i, x in ids.items() for k in range(0, len(x), 4096)}
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 4096
