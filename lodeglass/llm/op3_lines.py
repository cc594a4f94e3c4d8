"""Line deduplication by winnowing: later repeats of a run of lines go.

Of every ``run`` lines in a row the one with the least hash is a fingerprint, so two equal runs always share one. Only
fingerprints that occur twice are followed: around their places the runs are hashed whole, in both directions as far as
they hold the fingerprint, and the first place of each run is kept. A run is deleted wherever it begins later, by document
and line. Counts and first places are grouped, so no pairs of places are made, however often a run occurs.

Shorter runs may count too, if they hold enough words (``passage``). Each of them is its own fingerprint: they are few, as
the rest of the text has to be in longer lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm.common import BREAKS, Query, carried, pin, stage, table

#: Lines of the shortest run that counts as repeated.
RUN = 3
#: Words of the shortest passage that counts as repeated on fewer lines.
PASSAGE = 50


def _least(run: int) -> Column:
    """Places of the fingerprints among ``_h``: the least hash of each ``run`` lines, the last one on ties."""
    rank = lambda i: F.array_min(
        F.array(*[F.struct(F.get("_h", i + k).alias("hash"), (-(i + k)).alias("place")) for k in range(run)])
    )
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_h") - run), rank))


def _wordy(lines: int, passage: int) -> Column:
    """Places in ``_w``, the words of each line, where so many ``lines`` begin that hold ``passage`` words together."""
    held = lambda at: sum((F.get("_w", at + k) for k in range(1, lines)), F.get("_w", at))
    return F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda at: held(at) >= passage)


def _runs(begun: DataFrame, lines: int) -> DataFrame:
    """The runs of so many ``lines`` that begin at ``at``, with the lines of the text that go with them."""
    to = F.coalesce(F.get("_k", F.col("at") + lines), F.col("_n")) - 1
    return begun.select(
        "_id", "_key", "at", F.lit(lines).alias("long"),
        F.xxhash64(F.slice("_h", F.col("at") + 1, F.lit(lines))).alias("h"),
        F.xxhash64(F.slice("_g", F.col("at") + 1, F.lit(lines))).alias("g"),
        F.get("_k", F.col("at")).alias("from"), to.alias("to"),
    )


def dedup_lines(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    run: int = RUN,
    into: str = "lines",
    passage: int | None = PASSAGE,
) -> DataFrame:
    """``docs`` with ``into`` (which replaces a column of that name): n_lines (with words), n_removed and kept, the text without later repeated runs.

    Lines are parted by line feeds and compared whole; those without words are neither compared nor counted, and go
    with the line before them. Places are in order of ``id``, then line; a missing id is after all others. A run is
    deleted if the same ``run`` lines also begin at a smaller (id, line), judged on the input, and so are fewer lines in a
    row that hold at least ``passage`` words together (None: no shorter runs). So equal ids, and equal rows, do not delete
    each other's lines at the same place. Null and empty texts are kept as they are. Columns of any
    name pass through.
    """
    i, t = F.col(f"`{id}`"), F.col(f"`{text}`")
    given, back = carried(docs, into)
    rows = docs.select(*given, F.struct(i.isNull().alias("last"), i.alias("id")).alias("_id"), t.alias("_text"))
    rows = rows.withColumn("_key", F.xxhash64("_text"))
    numbered = F.transform(F.split("_text", "\n"), lambda x, k: F.struct(x.alias("line"), k.alias("k")))
    worded = F.filter(numbered, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    lines = pin(rows.select("_id", "_key", "_text"), _lines=worded).where(F.size("_lines") >= (1 if passage else run))
    n_words = lambda x: F.size(F.split(F.btrim(x["line"], F.lit(BREAKS)), r"[\x20\x09-\x0D]+"))
    counted = [F.transform("_lines", n_words).alias("_w")] if passage else []
    known = stage(
        lines.select(
            "_id",
            "_key",
            F.transform("_lines", lambda x: F.xxhash64(x["line"])).alias("_h"),
            F.transform("_lines", lambda x: F.xxhash64(F.lit(1), x["line"])).alias("_g"),
            F.transform("_lines", lambda x: x["k"]).alias("_k"),
            F.size(F.split("_text", "\n")).alias("_n"),
            *counted,
        ).dropDuplicates(["_id", "_key"])
    )
    prints = known.where(F.size("_h") >= run).select("_id", "_key", F.inline(_least(run)))
    again = prints.groupBy("hash").count().where("count > 1").select("hash")
    places = prints.join(again, "hash", "left_semi").groupBy("_id", "_key").agg(F.collect_set(-F.col("place")).alias("_at"))
    last = F.size("_h") - run
    near = F.array_distinct(
        F.flatten(F.transform("_at", lambda p: F.sequence(F.greatest(p - (run - 1), F.lit(0)), F.least(p, last))))
    )
    same = F.col("known._id").eqNullSafe(F.col("places._id")) & (F.col("known._key") == F.col("places._key"))
    around = known.alias("known").join(places.alias("places"), same).select("known.*", "_at")
    runs = _runs(around.select("_id", "_key", "_h", "_g", "_k", "_n", F.explode(near).alias("at")), run)
    for few in range(1, run if passage else 1):
        begun = known.select("_id", "_key", "_h", "_g", "_k", "_n", F.explode(_wordy(few, passage)).alias("at"))
        runs = runs.unionByName(_runs(begun, few))
    place = F.struct("_id", "at")
    first = runs.groupBy("long", "h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = runs.join(first, ["long", "h", "g"]).where(place > F.col("first"))
    gone = later.groupBy("_id", "_key").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence("from", "to")))).alias("_gone")
    )
    same = F.col("rows._id").eqNullSafe(F.col("gone._id")) & (F.col("rows._key") == F.col("gone._key"))
    out = rows.alias("rows").join(gone.alias("gone"), same, "left").select("rows.*", "_gone")
    has_words = lambda xs: F.filter(xs, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = pin(out, _lines=F.split("_text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(left, lambda k: F.get("_lines", k)))
    out = pin(out, _kept=kept, _worded=F.coalesce(F.size(has_words(F.col("_lines"))), F.lit(0)).cast("long"))
    n_kept = F.when(F.col("_gone").isNull(), F.col("_worded")).otherwise(F.size(has_words(F.col("_kept"))).cast("long"))
    return out.select(
        *back,
        F.struct(
            F.when(F.col("_text").isNull(), 0).otherwise(F.col("_worded")).cast("long").alias("n_lines"),
            F.when(F.col("_text").isNull(), 0).otherwise(F.col("_worded") - n_kept).cast("long").alias("n_removed"),
            F.array_join("_kept", "\n").alias("kept"),
        ).alias(into),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("lines.kept", F.lit("")), 256).alias("kept_sha256")
    return out.select("doc_id", "lines.n_lines", "lines.n_removed", kept)


SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lined AS (SELECT r, doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS k FROM docs),
worded AS (
  SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY r ORDER BY k) AS p
  FROM lined WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
ahead AS (
  SELECT r, doc_id, p, list(x) OVER w AS xs, list(words) OVER w AS ns FROM worded
  WINDOW w AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING)),
runs AS (
  SELECT r, doc_id, p, long, xs[1:long] AS g FROM ahead, (SELECT unnest(range(1, {RUN} + 1)) AS long)
  WHERE len(xs) >= long AND (long = {RUN} OR list_sum(ns[1:long]) >= {PASSAGE})),
firsts AS (SELECT g, min((doc_id, p)) AS first FROM runs GROUP BY g),
gone AS (
  SELECT DISTINCT r, p + k AS p FROM runs JOIN firsts USING (g), range({RUN}) AS s(k)
  WHERE k < long AND (doc_id, p) > first),
owned AS (
  SELECT l.r, l.k, l.x, w.p IS NOT NULL AS has_words, max(w.p) OVER (PARTITION BY l.r ORDER BY l.k) AS p
  FROM lined l LEFT JOIN worded w USING (r, k)),
left_over AS (
  SELECT o.r, count(*) FILTER (has_words) AS n, count(*) FILTER (has_words AND g.p IS NOT NULL) AS n_gone,
         string_agg(x, chr(10) ORDER BY k) FILTER (g.p IS NULL) AS kept
  FROM owned o LEFT JOIN gone g ON o.r = g.r AND o.p = g.p GROUP BY o.r)
SELECT doc_id, n AS n_lines, n_gone AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs JOIN left_over USING (r)
"""

QUERIES = {"op3_lines": Query(query, SQL)}
