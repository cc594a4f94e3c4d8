import random

import pytest

from pyspark.sql import functions as F

#: Names that operators use inside; documents may have columns of the same names.
CLASHES = ("key", "row", "words", "_row", "_words", "_found", "quality", "lines", "benchmark", "size", "list", "length")


def odd_documents(seed: int = 5) -> list[tuple]:
    """Small documents with nulls, blanks, ties, copies, near copies, shared passages, long and odd texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "straße", "Aé", "x|y", "fin."]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    lines = [prose(6) + "." for _ in range(12)]
    texts = [None, "", "   \n\t ", "one", "one", "One", "two words", "a b c d", "a b c d e", "A b C d e"]
    for _ in range(6):
        base = prose(rnd.randrange(30, 120))
        texts += [base, base, base.upper(), base + " tail", "head " + base]
        changed = base.split(" ")
        changed[rnd.randrange(len(changed))] = "changed"
        texts.append(" ".join(changed))
    for _ in range(8):
        texts.append(prose(rnd.randrange(5, 60)) + "\n" + passage + "  \r\n" + prose(rnd.randrange(5, 30)))
    for _ in range(10):
        start = rnd.randrange(8)
        texts.append("\n".join([prose(4), *lines[start : start + rnd.randrange(2, 6)], "", prose(5)]))
    texts += ["a " * 40, "x", "\u2003odd\u00a0space\u2003", "tab\tand\x0bmore\x0cends", prose(3000), "é" * 50, "\n\n" + lines[0] + "\n\n"]
    rows = [(k // 2 if k % 7 == 0 else k, t) for k, t in enumerate(texts)]
    rows += [(None, texts[10]), (None, passage), rows[12], rows[12], (-5, texts[11])]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    """Rows of id and text as documents, over several partitions, with columns whose names clash."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in CLASHES}).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def rows():
    return odd_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
