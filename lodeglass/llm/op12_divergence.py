"""Source divergence audit: how far each source's use of words is from that of other sources in its language.

Terms are counted per task before anything is exchanged. What two sources have in common is read from joint tables: for
counts c of one source and d of the other, the number of terms that have both. With a column per (source, count level)
that is 1 where a term has that level, the product of these columns' matrix with its transpose holds every joint table at
once. Each entry is then priced by how far the probabilities of its two levels are apart.

The matrix is cut into blocks of terms of about the same frequency, which have few levels, and of sources; every block's
product is exact, as it counts the block's terms. Blocks add up, so a task holds one block and its tables, however many
terms, sources and documents there are.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeglass.llm.common import Query, stage, table

#: Documents of a language that a term has to be in, ranks of terms that are reported, and what is added to each count.
MIN_DOCS, TOP, PRIOR = 30, 50, 5
#: Probabilities are whole parts of this.
UNIT = 1_000_000_000
#: Terms and sources of a block.
BLOCK_TERMS, BLOCK_SOURCES = 128, 32
#: Distinct terms that a task holds before it sends their counts on, and bytes of a long text that are cut at once.
HELD, PIECE = 300_000, 1 << 20

#: Bytes as they are in terms: letters folded, bytes of other than ASCII characters kept, the rest a gap.
_TERM_BYTES = bytes(
    ord(chr(b).lower()) if chr(b) in string.ascii_letters else b if b >= 0x80 else 0x20 for b in range(256)
)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, of a long one in several lists."""
    plain, at = text.translate(_TERM_BYTES), 0
    while len(plain) - at > PIECE:
        to = plain.find(b" ", at + PIECE)
        to = len(plain) if to < 0 else to
        yield plain[at:to].split()
        at = to
    yield plain[at:].split() if at else plain.split()


def _counted(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """``n`` occurrences of each term in each (lang, source), and the ``docs`` that hold it; a row without term for each
    group has its documents."""

    def batch(groups: dict) -> pa.RecordBatch:
        out = {name: [] for name in ("lang", "source", "term", "n", "docs")}
        for (own_lang, own_source), (n_docs, counts, holders) in groups.items():
            terms = list(counts)
            size = len(terms) + 1
            out["lang"].append(pa.repeat(own_lang, size))
            out["source"].append(pa.repeat(own_source, size))
            out["term"].append(pa.array([None, *terms], pa.binary()))
            out["n"].append(pa.array([0, *counts.values()], pa.int64()))
            out["docs"].append(pa.array([n_docs, *map(holders.__getitem__, terms)], pa.int64()))
        columns = {name: pa.concat_arrays(parts) for name, parts in out.items()}
        columns["term"] = columns["term"].cast(pa.string())
        return pa.RecordBatch.from_pydict(columns)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held = {}, 0
        for whole in rows:
            names = zip(whole.column("lang").to_pylist(), whole.column("source").to_pylist(), strict=True)
            for key, value in zip(names, whole.column("text").cast(pa.large_binary()), strict=True):
                group = groups.setdefault(key, [0, Counter(), Counter()])
                group[0] += 1
                before, own = len(group[1]), set()
                for terms in _pieces(value.as_py()):
                    group[1].update(terms)
                    own.update(terms)
                group[2].update(own)
                held += len(group[1]) - before
                if held > HELD:
                    yield batch(groups)
                    groups, held = {}, 0
        if groups:
            yield batch(groups)

    text_of = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    sent = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _price(n: str, total: str) -> Column:
    """The probability of a term that occurs ``n`` times, in parts of ``UNIT``, exactly; ``total`` counts the prior too."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({n} + {PRIOR} as decimal(20,0))) div cast({total} as decimal(20,0))")


def _levels(counts: np.ndarray, totals: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-hot rows for every (source, count level) of a block, where each source's begin, and the levels' prices."""
    rows, first, prices = [], [0], []
    for own, total in zip(counts, totals, strict=True):
        levels, at = np.unique(own, return_inverse=True)
        hot = np.zeros((len(levels), len(own)), np.float32)
        hot[at, np.arange(len(own))] = 1
        rows.append(hot)
        first.append(first[-1] + len(levels))
        prices += [1 + UNIT * (int(n) + PRIOR) // total for n in levels]
    return np.concatenate(rows), np.array(first), np.array(prices, np.int64)


def _block(rows: pa.Table) -> pa.Table:
    """Summed price differences of every two sources, ``g`` of the block's first set of sources and ``h`` of its second."""
    known = rows.filter(pa.compute.is_null(rows.column("term")))
    place = known.column("place").to_numpy()
    order = np.argsort(place)
    place = place[order]
    totals = [int(x) for x in known.column("total").to_numpy()[order]]
    sides = known.column("set").to_numpy()[order]
    cells = rows.filter(pa.compute.is_valid(rows.column("term")))
    terms = cells.column("term").combine_chunks().dictionary_encode()
    # terms that none of these sources has count as well: their probabilities differ by source
    counts = np.zeros((len(place), known.column("n")[0].as_py()), np.int64)
    at = np.searchsorted(place, cells.column("place").to_numpy())
    counts[at, terms.indices.to_numpy()] = cells.column("n").to_numpy()
    low, high = sides.min(), sides.max()
    value = np.zeros((len(place), len(place)), np.int64)
    if counts.shape[1]:
        hot, first, prices = _levels(counts, totals)
        for g in np.flatnonzero(sides == low):
            own = slice(first[g], first[g + 1])
            # joint tables of this source with all: float32 holds numbers up to the terms of a block
            joint = (hot[own] @ hot.T).astype(np.int64)
            priced = joint * np.abs(prices[own, None] - prices[None, :])
            value[g] = np.add.reduceat(priced.sum(axis=0), first[:-1])
    g, h = np.nonzero((sides == low)[:, None] & (sides == high)[None, :] & (place[:, None] != place[None, :]))
    both = np.append(g, h), np.append(h, g)
    if low == high:
        both = g, h
    one = np.tile(value[g, h], len(both[0]) // max(len(g), 1))
    return pa.table({"g": pa.array(place[both[0]]), "h": pa.array(place[both[1]]), "value": pa.array(one)})


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``g``, ``h`` and ``value`` for every two sources of a language, from the blocks' joint tables."""
    bucket = F.length(F.bin("every")).alias("bucket")
    sizes = kept.where("first").groupBy("lang", bucket).agg(F.ceil(F.count("*") / F.lit(BLOCK_TERMS)).cast("int").alias("blocks"))
    sizes = stage(sizes)
    placed = kept.select("lang", "source", "term", "n", "first", bucket).join(sizes, ["lang", "bucket"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    cells = (
        placed.join(groups.select("lang", "source", "place", "sets"), ["lang", "source"])
        .select("lang", "bucket", "block", "place", "sets", "term", "n", F.lit(None).cast("long").alias("total"))
    )
    # every block knows its number of terms and all its sources, also those that have none of the terms; a block without
    # terms stands for languages without
    listed = placed.where("first").groupBy("lang", "bucket", "block").agg(F.count("*").alias("n"))
    bare = groups.select("lang", F.lit(0).alias("bucket"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("n")).distinct()
    known = listed.unionByName(bare).join(groups.select("lang", "place", "sets", "total"), "lang")
    known = known.select("lang", "bucket", "block", "place", "sets", F.lit(None).cast("string").alias("term"), "n", "total")
    own = F.expr(f"(place - 1) div {BLOCK_SOURCES}").cast("int")
    dealt = cells.unionByName(known).select(
        "*", own.alias("set"), F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("other")
    )
    dealt = dealt.select(
        "lang", "bucket", "block", F.least("set", "other").alias("a"), F.greatest("set", "other").alias("b"), "set",
        "place", "term", "n", "total",
    )
    block = lambda key, rows: _with_lang(key, _block(rows))
    made = dealt.groupBy("lang", "bucket", "block", "a", "b").applyInArrow(block, "lang string, g int, h int, value long")
    return made.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def _with_lang(key: tuple, made: pa.Table) -> pa.Table:
    return made.add_column(0, "lang", pa.repeat(key[0].as_py(), len(made)))


def audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source the others of its language by distance (part ``pair``),
    and the ``top`` terms that it has more of than its language (part ``term``).

    Missing texts, languages and sources are taken as empty ones. Terms are runs of letters and of characters beyond
    ASCII, A-Z in lower case; a language keeps those that at least ``min_docs`` of its documents hold, equal documents
    each counted. A source without kept terms, and a language without any, has pairs all the same, with value 0 for the
    latter. Equal values rank by item, in byte order. A very long text is cut in pieces, its terms are not. No documents
    give no rows. Other columns are left out, whatever their names.
    """
    counted = stage(_counted(docs, lang, source, text))
    same = Window.partitionBy("lang", "term")
    kept = stage(
        counted.where("term is not null")
        .select(
            "lang", "source", "term", "n",
            F.sum("docs").over(same).alias("holders"),
            F.sum("n").over(same).alias("every"),
            (F.row_number().over(same.orderBy("source")) == 1).alias("first"),
        )
        .where(F.col("holders") >= min_docs)
        .drop("holders")
    )
    langs = kept.where("first").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("every").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    of_lang = Window.partitionBy("lang")
    terms, lang_n, own_n = (F.coalesce(c, F.lit(0)) for c in ("terms", "lang_n", "own_n"))
    groups = stage(
        counted.where("term is null").select("lang", "source")
        .join(own, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang", "source",
            (own_n + PRIOR * terms).alias("total"),
            (lang_n + PRIOR * terms).alias("lang_total"),
            F.row_number().over(of_lang.orderBy("source")).alias("place"),
            F.ceil(F.count("*").over(of_lang) / F.lit(BLOCK_SOURCES)).cast("int").alias("sets"),
        )
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    g, h = (groups.select("lang", F.col("source").alias(s), F.col("place").alias(p)) for s, p in (("source", "g"), ("item", "h")))
    pairs = _pairs(kept, groups).join(g, ["lang", "g"]).join(h, ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = pairs.withColumn("rank", F.row_number().over(by_value))
    more = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (_price("n", "total") - _price("every", "lang_total")).alias("value"),
    )
    best = more.where("value > 0").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return ranked.unionByName(best)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"))


SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
held AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS every FROM held GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
counts AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM held SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(every) AS total FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS total, coalesce(any_value(l.total), 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source
  LEFT JOIN langs l ON g.lang = l.lang GROUP BY g.lang, g.source),
priced AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         1 + ({UNIT}::HUGEINT * (coalesce(n, 0) + {PRIOR})) // (g.total + {PRIOR} * v)::HUGEINT AS p,
         1 + ({UNIT}::HUGEINT * (every + {PRIOR})) // (lang_total + {PRIOR} * v)::HUGEINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN apart a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM priced WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""

QUERIES = {"op12_divergence": Query(query, SQL)}
