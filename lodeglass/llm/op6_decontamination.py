"""Benchmark decontamination as a prefix-filtered set join with exact verification.

A benchmark item is cut into windows of words. A text contains a window only if it contains all of its words, so each
window is listed under its rarest word alone (the prefix that a set join for whole containment needs), with rarity
counted over the texts. Each place of that word is tested: room before and after it (length and position), the second
rarest word at its distance, and then all words of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm.common import Query, carried, fold, pin, stage, table

#: Words of a window.
WINDOW = 13
#: A document is contaminated when one in so many of its words is hit.
SHARE = 20
#: Bytes of benchmark windows up to which they are sent to every task; beyond, they are joined by shuffles.
BROADCAST_BYTES = 64 << 20
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def letter_words(text: Column) -> Column:
    """Runs of digits, letters and all beyond ASCII, with A-Z in lower case; null has none."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), _BREAK, -1), "")


def benchmark_windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct windows as arrays of words, with the ids (texts, sorted) of the items that have them.

    A shorter item is one window; one without words has none. Items without an id name nothing but their windows count.
    """
    worded = pin(items.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")), words=letter_words(F.col("text")))
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    cut = worded.where(n > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(window)))).alias("window"))
    return cut.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _bytes(df: DataFrame, *columns: Column) -> int:
    return df.agg(F.sum(sum(columns, F.lit(0)))).first()[0] or 0


def _listed(windows: DataFrame, worded: DataFrame, limit: int) -> DataFrame:
    """Windows under their rarest word, as ``word``, with its place, and the second rarest with its distance.

    A window with a word that no text has cannot occur and is left out.
    """
    places = windows.select("window", "items", F.posexplode("window").alias("place", "word"))
    vocabulary = stage(places.select("word").distinct())
    all_words = worded.select(F.explode("words").alias("word"))
    if _bytes(vocabulary, F.octet_length("word"), F.lit(32)) <= limit:
        counts = all_words.join(F.broadcast(vocabulary), "word").groupBy("word").count()
    else:
        counts = all_words.groupBy("word").count().join(vocabulary, "word")
    ranked = (
        places.join(counts, "word")
        .groupBy("window", "items")
        .agg(F.array_sort(F.collect_list(F.struct("count", "word", "place"))).alias("rank"))
        .where(F.size("rank") == F.size("window"))
    )
    rank = F.col("rank")
    return ranked.select(
        rank[0]["word"].alias("word"),
        rank[0]["place"].alias("place"),
        F.get(rank, F.lit(1))["word"].alias("second"),
        (F.get(rank, F.lit(1))["place"] - rank[0]["place"]).alias("distance"),
        "window",
        "items",
    )


def _hits(met: DataFrame) -> Column:
    """Whether a window occurs around the word ``at`` that it is listed under."""
    start, length = F.col("at") - F.col("place"), F.size("window")
    fits = (start >= 1) & (start + length <= F.size("words"))
    second = F.col("second").isNull() | (F.get("words", F.col("at") + F.col("distance")) == F.col("second"))
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.greatest(length, F.lit(1))) == F.col("window")
    return fits & second & same


_SPAN = "struct(at - place as at, at - place + size(window) as to)"


def _by_broadcast(keyed: DataFrame, listed: DataFrame, columns: list[str]) -> DataFrame:
    """Per document its ``columns``, n_words, spans and items, with all windows sent to every task."""
    # every text begins with an empty word, which meets one row without a window: so each document is there once
    none = listed.sparkSession.range(1).select(F.lit("").alias("word"), *[F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in listed.columns[1:]])
    met = keyed.select("*", F.posexplode("words").alias("at", "word")).join(F.broadcast(listed.unionByName(none)), "word")
    itself = F.col("window").isNull()
    hits = met.where(itself | _hits(met)).select(
        "key", *[F.when(itself, F.col(c)).alias(c) for c in columns], (F.size("words") - 1).alias("n"), "items",
        F.when(~itself, F.expr(_SPAN)).alias("span"),
    )
    return hits.groupBy("key").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in columns],
        F.max("n").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _by_shuffles(keyed: DataFrame, listed: DataFrame, columns: list[str]) -> DataFrame:
    """The same with words exchanged; only documents that meet a window's word are looked at again."""
    at = keyed.select("key", F.posexplode("words").alias("at", "word")).where("at > 0")
    met = at.join(listed.hint("merge"), "word").join(keyed.select("key", "words"), "key")
    hits = met.where(_hits(met)).select("key", "items", F.expr(_SPAN).alias("span"))
    found = hits.groupBy("key").agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    own = keyed.select("key", *columns, (F.size("words") - 1).cast("long").alias("n_words")).join(found, "key", "left")
    nothing = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("spans", "items")]
    return own.select("key", *columns, "n_words", *nothing)


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: int = SHARE, broadcast_bytes: int = BROADCAST_BYTES, columns: list[str] | None = None,
    into: str = "benchmark",
) -> DataFrame:
    """``docs`` with ``into`` (which replaces a column of that name): n_words, n_hit, items (ids as texts, sorted as texts) and contaminated.

    ``columns``: those of ``docs`` that are wanted (all); they go through one shuffle, so leave out long ones.

    A word is hit when it lies in any place of any window of an item. Contaminated: some word is hit, and at least one
    in ``share``. Null and empty texts have no words. Equal rows are judged each by itself. An empty benchmark hits
    nothing. Columns of any name pass through.
    """
    given, back = carried(docs.select(*[f"`{c}`" for c in columns]) if columns else docs, into)
    keyed = docs.select(*given, F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("key"))
    keyed = pin(keyed, words=F.concat(F.array(F.lit("")), letter_words(F.col("text")))).drop("text")
    worded = pin(docs.select(F.col(f"`{text}`").alias("text")), words=letter_words(F.col("text"))).select("words")
    listed = stage(_listed(stage(benchmark_windows(items, item, item_text, window)), worded, broadcast_bytes))
    # in memory an array has 8 bytes for each element and its text padded to 8, and a row is held twice while it is sent
    held = lambda c: F.octet_length(F.array_join(c, "")) + 12 * F.size(c) + 24
    size = _bytes(listed, F.lit(2) * (held("window") + held("items") + F.lit(120)))
    columns_in = [f"in{k}" for k in range(len(given))]
    if size <= broadcast_bytes:
        found = _by_broadcast(keyed, listed, columns_in)
    else:
        found = _by_shuffles(stage(keyed), listed, columns_in)
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["to"] - F.greatest(a["to"], s["at"]), F.lit(0))).alias("n"),
            F.greatest(a["to"], s["to"]).alias("to"),
        ),
        lambda a: a["n"].cast("long"),
    )
    judged = pin(found, n_hit=covered)
    dirty = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return judged.select(*back, F.struct("n_words", "n_hit", "items", dirty.alias("contaminated")).alias(into))


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"), columns=["doc_id"])
    return out.select(
        "doc_id", "benchmark.n_words", "benchmark.n_hit",
        F.size("benchmark.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("benchmark.items", ","), 256).alias("items_sha256"), "benchmark.contaminated",
    )


_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item, list_slice(ws, i, least(i + {WINDOW - 1}, len(ws))) AS g
  FROM items, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(g) AS n FROM wins),
grams AS (
  SELECT r, i, n, list_slice(ws, i, i + n - 1) AS g
  FROM docs, sizes, unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE len(ws) >= n),
hits AS (SELECT r, i, n, item FROM grams JOIN wins USING (g)),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(n)) AS k FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

QUERIES = {"op6_decontamination": Query(query, SQL)}
