"""Personal data, source divergence and vector codes on small odd tables, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import frame
from lodeglass.llm import op11_personal, op12_divergence, op13_codes

# ---- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if passes(kind, m.group())]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def spans_of(df):
    return [(r[0], [tuple(s) for s in r.spans]) for r in df.collect()]


ODD = [
    None, "", "a@b.c.+x@d.e", "ab@c..d", "ab@c@d.e x@y", "é.a@b-.c- z", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.02.3.4", "1.2.3", "+1 2 3 4 5 6 7 8 9 0)(",
    "+12345678", "+1-23.45(67)89.", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "0" * 12, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1",
    "\U0001f600 x@y.zz +49 301 5551234", "a" * 3000 + "@b.co", "+" * 50, "9" * 5000 + "." * 50,
]


def test_base_spans(spark, docs, rows, no_docs):
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choice("12 a@.+-() 0AKé\n4") for _ in range(rnd.randrange(1, 90))) for _ in range(150)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[2], "y"), (3, texts[3], "y")], "doc_id long, text string, spans string")
    got = op11_personal.find_personal(df.repartition(3), ["doc_id"])
    for i, spans in spans_of(got):
        assert [s for s in spans if s[0] in BASE] == base_spans(texts[2] if i is None else texts[i]), i
    assert got.count() == len(texts) + 2
    assert Counter(i for i, _ in spans_of(op11_personal.find_personal(docs, ["doc_id"]))) == Counter(i for i, _ in rows)
    assert op11_personal.find_personal(no_docs, ["doc_id"]).count() == 0


def test_very_long_texts_are_searched(spark):
    text = "1" * 1_000_000 + " " + "a" * 1_000_000 + "@" + "b." * 500_000 + " " + "+1 (" * 200_000 + " x@y.org"
    found = op11_personal.find_personal(spark.createDataFrame([(1, text)], "i int, text string"), ["i"]).first().spans
    assert [tuple(s) for s in found] == [("email", 1_000_001, 3_000_001), ("email", len(text) - 7, len(text))]


def weak_corpus(seed):
    """Texts with one span each, and whether it is personal."""
    rnd = random.Random(seed)
    name = lambda: f"{rnd.choice(op11_personal.GIVEN_NAMES)} {rnd.choice(['Keller', 'Moreau', 'Silva', 'Novak'])}"
    number = lambda: f"{rnd.randrange(202, 990)}-{rnd.randrange(202, 990)}-{rnd.randrange(1000, 9999)}"
    ssn = lambda: f"{rnd.randrange(100, 665)}-{rnd.randrange(10, 99)}-{rnd.randrange(1000, 9999)}"
    makers = [
        (lambda: f"the patient {name()}, seen", "name", True), (lambda: f"regards, Dr. {name()} ", "name", True),
        (lambda: f"phone {number()} now", "local", True), (lambda: f"call {number()} or", "local", True),
        (lambda: f"her ssn {ssn()} is", "id", True), (lambda: "iban DE89 3704 0044 0532 0130 00 for", "id", True),
        (lambda: f"the {rnd.choice(op11_personal.GIVEN_NAMES)} Street has", "name", False),
        (lambda: f"order {number()}x of", "local", False), (lambda: f"serial 1{number()[1:]}/7", "local", False),
        (lambda: "isbn 000-11-2222 by", "id", False), (lambda: "section DE11 3704 0044 0532 0130 00 of", "id", False),
        (lambda: "mail anna@mail.org ", "email", True), (lambda: "card 4111 1111 1111 1111 ", "card", True),
        (lambda: "version 12345678901234", "card", False), (lambda: "from +49 301 5551234 ", "phone", True),
    ]
    return [(make(), kind, true) for make, kind, true in (rnd.choice(makers) for _ in range(600))]


def test_spans_that_the_method_adds(spark):
    """Trained without labels, it tells true spans from false ones, also in texts made anew."""
    cases = weak_corpus(1)
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    found = dict(spans_of(op11_personal.find_personal(df, ["doc_id"])))
    right = [(kind in {s[0] for s in found[k]}) == true for k, (_, kind, true) in enumerate(cases)]
    assert sum(right) / len(right) > 0.95


def plain_estimate(patterns, n_kinds):
    """The same estimates with loops."""
    n_labelers = len(op11_personal.LABELERS)
    chance = [1 / (1 + math.exp(-sum({0: 0, 1: 1, 2: -1, 3: 0}[v] for v in votes))) for _, votes, _ in patterns]
    for _ in range(op11_personal.ROUNDS + 1):
        right = []
        for k in range(n_kinds):
            own = [(n, c) for (kind, _, n), c in zip(patterns, chance, strict=True) if kind == k]
            right.append((sum(n * c for n, c in own) + 1) / (sum(n for n, _ in own) + 2))
        theta = np.ones((n_labelers, 2, 4))
        for (_, votes, n), c in zip(patterns, chance, strict=True):
            for j, v in enumerate(votes):
                theta[j, 1, v] += n * c
                theta[j, 0, v] += n * (1 - c)
        theta /= theta[:, :, :3].sum(axis=2, keepdims=True)
        theta[:, :, 3] = 1
        chance = []
        for kind, votes, _ in patterns:
            odds = math.log(right[kind] / (1 - right[kind])) + sum(math.log(theta[j, 1, v] / theta[j, 0, v]) for j, v in enumerate(votes))
            chance.append(1 / (1 + math.exp(-odds)))
    return right, theta


def test_estimates(spark):
    rnd = random.Random(9)
    patterns = {(rnd.randrange(3), tuple(rnd.choice([0, 1, 1, 2, 3]) for _ in op11_personal.LABELERS)): float(rnd.randrange(1, 50)) for _ in range(40)}
    patterns = sorted((k, list(v), n) for (k, v), n in patterns.items())
    df = spark.createDataFrame([(patterns,)], "p array<struct<kind:int,votes:array<int>,n:double>>")
    got = df.select(op11_personal.estimate(F.col("p"), 4).alias("e")).first()["e"]
    right, theta = plain_estimate(patterns, 4)
    assert np.allclose(got["right"], right) and np.allclose(got["theta"], theta.reshape(len(theta), 8))


# ---- source divergence


def plain_audit(rows, min_docs, top):
    counts, holders, groups = {}, {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        for t in terms:
            counts[lang, source, t] = counts.get((lang, source, t), 0) + 1
        for t in set(terms):
            holders[lang, t] = holders.get((lang, t), 0) + 1
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (own, t), n in holders.items() if own == lang and n >= min_docs)
        sources = sorted(s for g, s in groups if g == lang)
        count = {s: [counts.get((lang, s, t), 0) for t in kept] for s in sources}
        count[None] = [sum(c) for c in zip(*count.values(), strict=True)]
        p = {s: [1 + 10**9 * (n + 5) // (sum(c) + 5 * len(kept)) for n in c] for s, c in count.items()}
        for s in sources:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            terms = [(a - b, t) for a, b, t, n in zip(p[s], p[None], kept, count[s], strict=True) if n and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return out


def corpus(n_sources, seed=2):
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"] + ["É", "straße", "aé", "ДА"]
    rows = [(None, "en", "s0"), ("", "xx", None), ("1 2 - .", "xx", "only"), ("lone words", None, None), ("A a B", "de", "one")]
    for k in range(400):
        weights = [1 / (1 + j + k % 3) for j in range(len(vocabulary))]
        text = rnd.choice([" ", "-", "9", "\n"]).join(rnd.choices(vocabulary, weights, k=rnd.randrange(0, 40)))
        rows.append((text.upper() if k % 9 == 0 else text, rnd.choice(["en", "en", "fr"]), f"s{rnd.randrange(n_sources)}"))
    return rows + rows[7:9]


@pytest.mark.parametrize("n_sources, block_terms, block_sources", [(5, 128, 32), (23, 4, 6), (9, 1, 1)])
def test_audit(spark, monkeypatch, n_sources, block_terms, block_sources):
    """Blocks of any size give the same distances: several sets of sources, single terms, sources without terms."""
    monkeypatch.setattr(op12_divergence, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(op12_divergence, "BLOCK_SOURCES", block_sources)
    rows = corpus(n_sources)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "text string, lang string, source string, term string, place string").repartition(3)
    got = op12_divergence.audit(df, min_docs=4, top=7)
    want = plain_audit(rows, 4, 7)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want) and len(want) > 40
    assert [t for _, t in got.dtypes][-2:] == ["bigint", "int"]


def test_audit_of_nothing_and_of_odd_documents(docs, no_docs):
    assert op12_divergence.audit(no_docs).count() == 0
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert Counter(tuple(r) for r in op12_divergence.audit(docs, min_docs=2).collect()) == Counter(plain_audit(rows, 2, 50))


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(op12_divergence, "PIECE", 7)
    for text in ("", "abc", "word " * 9 + "averyverylongone" * 3 + " x", "É1" * 20):
        cut = [t for piece in op12_divergence._pieces(text.encode()) for t in piece]
        assert cut == [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower() if text.isascii() else text)]


def test_exact_price_of_large_counts(spark):
    cases = [(0, 10), (7, 1000), (10**12 - 3, 10**13), (123456789012345678, 9 * 10**17)]
    df = spark.createDataFrame(cases, "n long, total long").select("n", "total", op12_divergence._price("n", "total").alias("p"))
    assert {r.p for r in df.collect()} == {1 + 10**9 * (n + 5) // t for n, t in cases}


# ---- vector codes


def plain_codes(rows, parts, entries, rounds):
    whole = lambda v: [math.floor(1024 * x) for x in v]
    kept = [(i, whole(v), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fill = lambda v: v + [0] * (parts * width - len(v))
    cut = lambda v, p: fill(v)[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in order[:entries]] for p in range(parts)]

    def near(v, p):
        away = [sum((a - b) ** 2 for a, b in zip(cut(v, p), entry, strict=True)) for entry in books[p]]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        used = {}
        for _, v, _ in kept:
            for p in range(parts):
                used.setdefault((p, near(v, p)[0]), []).append(cut(v, p))
        for (p, e), own in used.items():
            books[p][e] = [sum(xs) // len(own) for xs in zip(*own, strict=True)]
    out = []
    for i, v, label in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, label, bytes(e for e, _ in found), sum(d for _, d in found)))
    return out, books


def vectors(n, size, seed=1, scale=0.2):
    rnd = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in rnd.normal(0, scale, size).astype(np.float32)], int(k % 3) if k % 5 else None) for k in rnd.permutation(n)]
    odd = [(900, None, 1), (901, [None, *rows[0][1][1:]], 1), (902, [float("nan")] * size, 2), (903, [float("-inf")] * size, 2)]
    return rows + odd + [rows[3], rows[3], (None, rows[4][1], 0), (-1, rows[5][1][: size - 2], 1), (1, rows[6][1], 1)]


@pytest.mark.parametrize("n, size, entries, scale", [(60, 8, 16, 0.2), (9, 16, 256, 0.2), (40, 6, 4, 3e4), (40, 8, 5, 1e12)])
def test_codes(spark, n, size, entries, scale):
    """Few vectors, ties, repeats, null and odd rows, vectors of other lengths, and components of any size."""
    rows = vectors(n, size, scale=scale)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, label int, v int, code string").repartition(4)
    kept = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    out, books = op13_codes.compress(df, entries=entries)
    want, want_books = plain_codes(kept, 4, entries, 4)
    assert books.tolist() == want_books
    got = [(r.vec_id, r.label, bytes(r.code), int(r.error)) for r in out.collect()]
    assert Counter(got) == Counter(want)
    total = Counter()
    for _, label, _, error in want:
        total[label] += error
    named = op13_codes.with_label_error(out).collect()
    assert len(named) == len(want) and all(int(r.label_error) == total[r.label] for r in named)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 2), (2, [float("nan")], 2)], "vec_id long, embedding array<float>, label int")
    for rows in (df, df.where("false")):
        out, books = op13_codes.compress(rows)
        assert out.count() == 0 and books.size == 0
    out, books = op13_codes.compress(spark.createDataFrame([(1, [], 2)], "vec_id long, embedding array<float>, label int"))
    assert [tuple(r) for r in op13_codes.with_label_error(out).select("code", "label_error").collect()] == [(b"\0\0\0\0", 0)]


@given(st.lists(st.lists(st.integers(-(2**27), 2**27), min_size=3, max_size=3), min_size=1, max_size=6), st.integers(0, 2**31))
@settings(max_examples=200, deadline=None)
def test_exact_products(values, seed):
    a = np.array(values, np.int64)
    b = np.random.default_rng(seed).integers(-(2**30), 2**30, (5, 3))
    assert op13_codes.exact_products(a, b).tolist() == (a.astype(object) @ b.T.astype(object)).tolist()
    for bits in (1, 9, 24):
        parts = op13_codes.limbs(a, bits)
        assert sum(p.astype(np.int64) << (bits * k) for k, p in enumerate(parts)).tolist() == a.tolist()
        assert all((p >= 0).all() and (p < 2**bits).all() for p in parts[:-1])


def test_odd_documents_have_all_columns(spark, rows):
    """Clashing names are the caller's, not the operators'."""
    out = op11_personal.find_personal(frame(spark, rows), ["doc_id", "key", "row"])
    assert out.columns == ["doc_id", "key", "row", "spans"]
