"""Every registered query of the subpackage against its SQL, or against whole-table brute force, on the smallest tables."""

import pathlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import brute
from lodeglass.llm import QUERIES

FOLDER = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_sql(spark, duck, name):
    df = QUERIES[name].build(spark, str(FOLDER))
    columns = sorted(df.columns)
    cursor = duck.execute(QUERIES[name].sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    got = [tuple(r) for r in df.select(columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def whole_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts}


def test_token_files(spark, texts):
    at, want = 0, set()
    for i, ids in whole_ids(texts).items():
        want.add((i, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    got = QUERIES["op5_token_files"].build(spark, str(FOLDER))
    assert {tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_packing(spark, texts):
    ids, bins, covered = whole_ids(texts), defaultdict(list), Counter()
    for r in QUERIES["op9_packing"].build(spark, str(FOLDER)).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        assert r.start == 4096 * r.piece
        bins[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id] += r.length
    assert covered == {i: len(x) for i, x in ids.items()}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.02 * -(-sum(covered.values()) // 4096) + 1


def test_jaccard(spark, texts):
    group, sets = brute.groups(texts)
    least = {}
    for (i, _), g in zip(texts, group, strict=True):
        least[g] = min(least.get(g, i), i)
    want = {(i, len(s), least[g] if g is not None else i) for (i, _), g, s in zip(texts, group, sets, strict=True)}
    got = QUERIES["op8_jaccard"].build(spark, str(FOLDER))
    assert {tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()} == want


def test_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_quality_keeps_good_labels(spark, duck):
    good = {r[0] for r in duck.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    judged = QUERIES["op10_quality"].build(spark, str(FOLDER)).where("not base_failed and not kept").collect()
    assert not good & {r.doc_id for r in judged}


def test_native_plans(spark):
    for name in ("op1_secrets", "op2_urls", "op4_chat", "op6_decontamination", "op10_quality", "op11_personal"):
        plan = QUERIES[name].build(spark, str(FOLDER)).select(F.count("*"))._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop")), name
