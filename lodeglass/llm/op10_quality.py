"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm.common import BREAKS, Query, carried, pin, table, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated when it occurs twice in a text.
WINDOW = 8
#: Words that a document needs.
MIN_WORDS = 20
#: Percent of words in repeated windows above which a document fails.
MAX_REPEATED = 30
#: Percent of the characters in lines that a document may lose.
MAX_LOST = 50
#: Words of a menu line at most for each separator, and separators at least.
MENU_WORDS, MENU_MARKS = 3, 3
#: Line ends that close a sentence, before closing quotes and brackets.
SENTENCE_END = r"""[.!?…:;。！？]["'”’»)\]]*[\x20\x09-\x0D]*$"""
#: A sentence end within a line, and the words of a line that may be cut off after it.
SENTENCE_INSIDE, CUT_WORDS = r"""[.!?…。！？]["'”’»)\]]*[\x20\x09-\x0D]""", 20
#: Phrases that mark a short line as boilerplate.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "sign up for our newsletter", "subscribe to our newsletter", "click here", "read more", "share this", "lorem ipsum",
)
#: Words of a boilerplate line at most.
BOILERPLATE_WORDS = 12
#: In runs of words, symbols or exclamation marks for every word mark a line as noise from so many of them on.
NOISE_MARKS = 5


def line_fails(line: Column) -> Column:
    """Whether a line with words is no sentence, a menu, boilerplate or noise.

    A long line with a sentence end inside is prose that was cut off, and passes.
    """
    n = F.size(words(line))
    marks = F.length(line) - F.length(F.translate(line, "|»•›", ""))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS + "!", ""))
    phrase = "|".join(BOILERPLATE)
    return (
        (~line.rlike(SENTENCE_END) & ~((n >= CUT_WORDS) & line.rlike(SENTENCE_INSIDE)))
        | ((marks >= MENU_MARKS) & (n <= (marks + 1) * MENU_WORDS))
        | ((n <= BOILERPLATE_WORDS) & F.lower(line).rlike(phrase))
        | ((symbols >= NOISE_MARKS) & (symbols >= n))
    )


def _repeated(df: DataFrame) -> DataFrame:
    """Adds ``_repeated``: the words within windows that occur more than once, from ``_words``.

    Windows are compared by a hash of their words' hashes. Only texts with a window twice sort their windows.
    """
    n = F.size("_words")
    df = pin(df, _hashes=F.transform("_words", lambda w: F.xxhash64(w)))
    gram = lambda i: F.xxhash64(*[F.col("_hashes")[i + k] for k in range(WINDOW)])
    df = pin(
        df,
        _grams=F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), gram)).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    pairs = F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("_grams")) < F.size("_grams")
    df = pin(df.drop("_hashes"), _sorted=F.when(twice, pairs).otherwise(pairs_none()))
    s = F.col("_sorted")
    same = lambda x, i: (
        ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    )
    starts = F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return pin(df.drop("_grams"), _repeated=covered.cast("long")).drop("_sorted")


def pairs_none() -> Column:
    return F.array().cast("array<struct<h:bigint,i:int>>")


def judge_quality(
    docs: DataFrame, text: str = "text", max_lost: int = MAX_LOST, into: str = "quality"
) -> DataFrame:
    """``docs`` with ``into``: measures, verdict and the cleaned text.

    ``into`` (which replaces a column of that name) is a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
    line_chars, kept and clean. ``clean`` is the text without failing lines; lines without words stay. A document is
    kept if it passes the base rules and loses at most ``max_lost`` percent of the characters in its lines.

    A null text is an empty one: no words, base_failed, clean null. Equal rows get equal results, since each row is
    judged by itself; columns of any name pass through.
    """
    t = F.col("_text")
    given, back = carried(docs, into)
    df = docs.select(*given, F.col(f"`{text}`").alias("_text"))
    df = _repeated(pin(df, _words=words(t)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = pin(df, _lines=F.coalesce(lines, F.array().cast("array<string>")))
    judged = F.transform(
        F.split(t, "\n"),
        lambda x: F.struct(x.alias("line"), (x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x)).alias("bad")),
    )
    df = pin(df, _judged=judged)
    length = lambda rows: F.aggregate(rows, F.lit(0), lambda a, x: a + F.length(x))
    bad = F.transform(F.filter("_judged", lambda x: x["bad"]), lambda x: x["line"])
    good = F.transform(F.filter("_judged", lambda x: ~x["bad"]), lambda x: x["line"])
    dense = F.translate(F.coalesce(t, F.lit("")), BREAKS, "")
    df = pin(
        df,
        _n=F.size("_words").cast("long"),
        _dense=dense,
        _lost=F.coalesce(length(bad), F.lit(0)).cast("long"),
        _all=length(F.col("_lines")).cast("long"),
    )
    failed = (F.col("_n") < MIN_WORDS) | (100 * F.col("_repeated") > MAX_REPEATED * F.col("_n"))
    return df.select(
        *back,
        F.struct(
            F.col("_n").alias("n_words"),
            F.length("_dense").cast("long").alias("word_chars"),
            (F.length("_dense") - F.length(F.translate("_dense", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.col("_repeated").alias("n_repeat_words"),
            failed.alias("base_failed"),
            F.col("_lost").alias("lost_chars"),
            F.col("_all").alias("line_chars"),
            (~failed & (100 * F.col("_lost") <= max_lost * F.col("_all"))).alias("kept"),
            F.array_join(good, "\n").alias("clean"),
        ).alias(into),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]
    return judge_quality(docs).select("doc_id", *[f"quality.{f}" for f in fields])


_BREAK = r"[\x20\x09-\x0D]"
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (
  SELECT r, list_filter(regexp_split_to_array(text, '{_BREAK}+'), lambda w: w <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
grams AS (
  SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS g
  FROM worded, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i) WHERE len(w) >= {WINDOW}),
again AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM grams JOIN again USING (r, g), range({WINDOW}) AS s(k) GROUP BY r),
lined AS (SELECT r, unnest(lines) AS x FROM worded),
judged AS (
  SELECT r, length(x) AS n, coalesce(
    (NOT regexp_matches(x, '[.!?…:;。！？]["''”’»)\]]*[\x20\x09-\x0D]*$')
     AND NOT (nw >= {CUT_WORDS} AND regexp_matches(x, '[.!?…。！？]["''”’»)\]]*[\x20\x09-\x0D]')))
    OR (m >= {MENU_MARKS} AND nw <= (m + 1) * {MENU_WORDS})
    OR (nw <= {BOILERPLATE_WORDS} AND regexp_matches(lower(x), '{"|".join(BOILERPLATE)}'))
    OR (s >= {NOISE_MARKS} AND s >= nw), false) AS bad
  FROM (SELECT *, len(list_filter(regexp_split_to_array(x, '{_BREAK}+'), lambda w: w <> '')) AS nw,
               length(x) - length(translate(x, '|»•›', '')) AS m,
               length(x) - length(translate(x, '{SYMBOLS}!', '')) AS s FROM lined)),
loss AS (SELECT r, sum(n) AS line_chars, coalesce(sum(n) FILTER (bad), 0) AS lost FROM judged GROUP BY r),
measured AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '{_BREAK}', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         coalesce(lost, 0) AS lost_chars, coalesce(line_chars, 0) AS line_chars
  FROM docs d JOIN worded USING (r) LEFT JOIN covered c USING (r) LEFT JOIN loss USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
         AND 100 * lost_chars <= {MAX_LOST} * line_chars AS kept,
       lost_chars::BIGINT AS lost_chars
FROM measured
"""

QUERIES = {"op10_quality": Query(query, SQL)}
