"""Association-rule URL filtering: FP-growth over the tokens of labelled URLs, rules matched by an inverted index."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm.common import Query, fold, pin, stage, table

#: Share of labelled URLs that a combination needs, and share of those with it that are bad.
SUPPORT, CONFIDENCE = 0.005, 0.45
#: The item of bad URLs; tokens of URLs all have a colon.
BAD = "bad"
#: Verdicts by host and path, as the contract gives them.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; empty where there is none."""
    return fold(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    return F.when(start > 0, F.substr(url, start + 3)).otherwise("")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """What a URL is made of: host labels, path segments with digits as ``#``, query keys and a fragment mark.

    Segments and keys that differ by their numbers alone become one token, so equal token sets are common.
    """
    some = lambda parts: F.filter(parts, lambda x: x != "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    named = lambda mark, parts: F.transform(parts, lambda x: F.concat(F.lit(mark), x))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                named("host:", some(F.split(host, r"\."))),
                named("path:", F.transform(some(F.split(path, "/")), lambda x: F.regexp_replace(x, "[0-9]+", "#"))),
                named("key:", F.transform(some(F.split(query, "&")), lambda x: F.regexp_extract(x, "^[^=]*", 0))),
                F.when(_rest(url).contains("#"), F.array(F.lit("mark:#"))).otherwise(F.array().cast("array<string>")),
            )
        )
    )


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Token combinations that tell bad URLs, as a written table of ``tokens`` and the ``anchor`` they are listed under.

    ``labelled`` has ``tokens`` and ``bad``. The anchor is a combination's rarest token among the labelled. The table
    is bounded: a combination has at least ``support`` of the labelled URLs, and a URL has few tokens.
    """
    items = F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens"))
    carts = labelled.select(items.alias("items"))
    schema = "tokens array<string>, anchor string"
    if carts.isEmpty():
        return carts.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(carts)
    tokens = model.associationRules.where(F.col("consequent")[0] == BAD).select(F.col("antecedent").alias("tokens"))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    ranked = tokens.select("tokens", F.explode("tokens").alias("token")).join(single, "token")
    return stage(ranked.groupBy("tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor")))


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens`` of ``sets`` that hold every token of some rule, with the number of such rules.

    A rule is looked up by its anchor alone, so a set meets it once, and only if it has the rarest token.
    """
    rules = rules.select(F.col("tokens").alias("rule"), "anchor")
    met = sets.select("tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor")
    return met.where(F.size(F.array_except("rule", "tokens")) == 0).groupBy("tokens").agg(F.count("*").alias("n_rules"))


def judge_urls(pages: DataFrame, labels: DataFrame, page: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """``page``, host, path, rule and verdict of every row of ``pages``, and the number of mined rules that it meets.

    ``labels`` has ``page`` and ``bad``; a page labelled twice is bad if either says so. The longest of ``rules`` (a
    short list of verdict, host and path) that fits decides; else a page that meets a mined rule is blocked and any
    other allowed. A null or odd URL has an empty host and path, no tokens, and is allowed. Equal rows get equal results.
    """
    u = F.col("url")
    df = pages.select(F.col(f"`{page}`").alias("page"), F.col(f"`{url}`").alias("url"))
    df = pin(df, host=url_host(u), path=url_path(u))
    df = df.select("page", "host", "path", url_tokens(u, F.col("host"), F.col("path")).alias("tokens"))
    told = labels.groupBy(F.col(page).alias("page")).agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    labelled = df.join(told, "page").select("tokens", "bad")
    matched = match_rules(df.select("tokens").distinct(), mine_rules(labelled))
    host, path = F.col("host"), F.col("path")
    fitting, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, under = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + under)
        fitting, verdict = F.when(fits, rule).otherwise(fitting), F.when(fits, said).otherwise(verdict)
    n = F.coalesce("n_rules", F.lit(0)).cast("long")
    return (
        df.join(matched, "tokens", "left")
        .select("page", "host", "path", n.alias("n_rules"), fitting.alias("rule"), verdict.alias("said"))
        .select(
            F.col("page").alias(page), "host", "path", "rule", "n_rules",
            F.coalesce("said", F.when(F.col("n_rules") > 0, "block").otherwise("allow")).alias("verdict"),
        )
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of documents stand for those of the pages with the same number."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    return judge_urls(table(spark, folder, "pages"), labels)


def _sql() -> str:
    fits = lambda rule: (
        f"(host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) "
        f"AND starts_with(path, '/{rule.partition('/')[2]}')"
    )
    by_length = sorted(RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in by_length) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in by_length) + " END"
    return rf"""
WITH rest AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
parts AS (
  SELECT r, page_id, x, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
made AS (
  SELECT r, 'host:' || unnest(string_split(host, '.')) AS t FROM parts
  UNION SELECT r, 'path:' || regexp_replace(unnest(string_split(path, '/')), '[0-9]+', '#', 'g') FROM parts
  UNION SELECT r, 'key:' || regexp_extract(unnest(string_split(regexp_extract(x, '^[^?#]*\?([^#]*)', 1), '&')), '^[^=]*')
        FROM parts
  UNION SELECT r, 'mark:#' FROM parts WHERE contains(x, '#')),
sets AS (SELECT r, list(t ORDER BY t) AS ts FROM made WHERE NOT ends_with(t, ':') GROUP BY r),
told AS (SELECT doc_id AS page_id, max(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
carts AS (SELECT coalesce(ts, []) AS ts, bad FROM parts JOIN told USING (page_id) LEFT JOIN sets USING (r)),
least AS (SELECT ceil({SUPPORT} * count(*)) AS n FROM carts),
combos AS (
  SELECT list_filter(ts, lambda t, i: (m >> (i - 1)) & 1 = 1) AS c, bad
  FROM carts, unnest(range(1, (1 << len(ts))::BIGINT)) AS s(m)),
mined AS (
  SELECT c FROM combos GROUP BY c
  HAVING count(*) FILTER (bad) >= (SELECT n FROM least) AND count(*) FILTER (bad) / count(*) >= {CONFIDENCE}),
hits AS (SELECT r, count(*) AS n FROM sets, mined WHERE list_has_all(ts, c) GROUP BY r)
SELECT page_id, host, path, {rule} AS rule, coalesce(n, 0)::BIGINT AS n_rules,
       coalesce({said}, CASE WHEN n > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN hits USING (r)
"""


SQL = _sql()

QUERIES = {"op2_urls": Query(query, SQL)}
