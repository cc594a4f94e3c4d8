"""Multipart credential linking: identifiers, secrets and endpoints found in texts and joined by distance.

Strong secrets are reported by themselves. A weak part (a token that only looks random, an account name, an endpoint)
is reported only when a part that completes it lies within reach in the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeglass.llm.common import Query, stage, table

#: Strong kinds in order: pattern, the group that is measured, its least length. Names match in either case. A run that
#: is too short to count holds no shorter run that does, so those patterns ask for the length at once; an assignment
#: that fails uses up its text, so its length is tested afterwards.
STRONG = {
    "assign": (
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6,
    ),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
_TOKEN = "[A-Za-z0-9+/_-]"
#: The same for kinds that need company: a long token of digits and both cases, an account name, an endpoint.
WEAK = {
    "weak": (rf"(?<!{_TOKEN})(?={_TOKEN}*[0-9])(?={_TOKEN}*[a-z])(?={_TOKEN}*[A-Z]){_TOKEN}{{32,}}", 0, 32),
    "account": (
        r"(?i:(user_?name|client_?id|account|login|user))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]+)", 2, 3,
    ),
    "endpoint": (r"(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@%/?&=+-]+", 0, 10),
}
KINDS = STRONG | WEAK
#: What completes a weak part: an identifier or endpoint for a secret, a secret for those.
PARTNERS = {
    "weak": ("access", "account", "endpoint"),
    "account": ("assign", "hex", "weak"),
    "endpoint": ("assign", "hex", "weak"),
}
#: Code points between parts that belong together, at most.
REACH = 200


def _runs(text: Column, pattern: str, group: int) -> Column:
    """Gap before, length, and measured length of each match, leftmost first and not overlapping.

    ``split`` and ``regexp_extract_all`` walk the same matches, so gaps and matches alternate.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), measured.alias("measured"))
    rows = F.transform(
        F.filter(zipped, lambda x: x["found"].isNotNull()),
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("n"), F.length(x["measured"]).alias("m")
        ),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<gap:int,n:int,m:int>>"))


def _placed(rows: DataFrame) -> DataFrame:
    """Kind, start and end of the runs that are long enough; positions are sums over the runs before."""
    rows = rows.select("key", F.inline("found")).select("key", "kind", "least", F.posexplode("runs").alias("k", "run"))
    w = Window.partitionBy("key", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    until = F.sum(F.col("run.gap").cast("long") + F.col("run.n")).over(w)
    ends = rows.select("key", "kind", "least", "run", until.alias("until")).where("run.m >= least")
    return ends.select("key", "kind", (F.col("until") - F.col("run.n")).alias("at"), "until")


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """``parts`` (key, kind, at, until) that stand: strong ones, and weak ones with a partner of the same key within
    ``reach``.

    An interval join without pairs: positions are cut into bins as wide as the reach, and each bin keeps, per kind,
    the first start and the last end of the parts that touch it. A weak part reads the bins that its reach touches.
    Only its outermost bins can hold parts too far away, and there the nearest start or end decides.
    """
    at, until = F.col("at"), F.col("until")
    place = lambda x: F.floor(x / reach).cast("long")
    bins = (
        parts.select("key", F.col("kind").alias("other"), "at", "until", F.explode(F.sequence(place(at), place(until))).alias("bin"))
        .groupBy("key", "other", "bin")
        .agg(F.min("at").alias("first"), F.max("until").alias("last"))
    )
    wants = F.create_map(*[x for k, v in PARTNERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    needy = F.col("kind").isin(*PARTNERS)
    near = (
        parts.where(needy)
        .select("key", "kind", "at", "until", F.explode(wants[F.col("kind")]).alias("other"))
        .select("*", F.explode(F.sequence(place(at - reach), place(until + reach))).alias("bin"))
    )
    within = (F.col("first") <= until + reach) & (F.col("last") >= at - reach)
    linked = near.join(bins, ["key", "other", "bin"]).where(within).select(parts.columns).distinct()
    return parts.where(~needy).unionByName(linked)


def scan_secrets(docs: DataFrame, ids: list[str], text: str = "text", reach: int = REACH) -> DataFrame:
    """``ids`` of every row, and ``spans``: kind, start and end (code points, end exclusive) by start, then kind.

    Null and empty texts have no spans. Each row is scanned by itself, so equal rows get equal spans and ids may be
    null or repeat. Other columns are left out, whatever their names.
    """
    t = F.col(f"`{text}`")
    found = F.filter(
        F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), F.lit(least).alias("least"), _runs(t, pattern, group).alias("runs"))
                for kind, (pattern, group, least) in KINDS.items()
            ]
        ),
        lambda x: F.size(x["runs"]) > 0,
    )
    row = F.struct(*[F.col(f"`{c}`") for c in ids]).alias("row")
    keyed = stage(docs.select(row, F.monotonically_increasing_id().alias("key"), found.alias("found")))
    parts = _placed(keyed.where(F.size("found") > 0))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    spans = (
        link_parts(parts, reach)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("at", order[F.col("kind")].alias("o"), "kind", "until"))).alias("s"))
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    tidy = F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["at"].alias("start"), x["until"].alias("end")))
    return keyed.join(spans, "key", "left").select("row.*", F.coalesce(tidy, none).alias("spans"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda x: x["kind"].isin(*STRONG))
    return found.select(
        "doc_id", *map(count, STRONG), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def _sql_spans(kind: str, order: int) -> str:
    pattern, group, least = KINDS[kind]
    pattern = pattern.replace("'", "''")
    measured = f"regexp_extract_all(text, '{pattern}', {group})"
    return f"""
  SELECT r, '{kind}' AS kind, {order} AS o, u - length(f) AS a, u, m FROM (
    SELECT r, f, length(v) AS m, sum(length(gap) + length(f)) OVER (PARTITION BY r ORDER BY k) AS u FROM (
      SELECT r, generate_subscripts(fs, 1) AS k, unnest(fs) AS f, unnest(vs) AS v,
             unnest(list_slice(gaps, 1, len(fs))) AS gap FROM (
        SELECT r, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS fs,
               {measured} AS vs FROM docs) WHERE len(fs) > 0)) WHERE m >= {least}"""


#: DuckDB has no look-around, so it finds long tokens first and tests the letters afterwards.
def _sql() -> str:
    kinds = " UNION ALL ".join(_sql_spans(k, i) for i, k in enumerate(KINDS) if k != "weak")
    tokens = f"""
  SELECT r, 'weak' AS kind, {list(KINDS).index('weak')} AS o, u - length(f) AS a, u, length(f) AS m FROM (
    SELECT r, f, sum(length(gap) + length(f)) OVER (PARTITION BY r ORDER BY k) AS u FROM (
      SELECT r, generate_subscripts(fs, 1) AS k, unnest(fs) AS f, unnest(list_slice(gaps, 1, len(fs))) AS gap FROM (
        SELECT r, string_split_regex(text, '{_TOKEN}{{32,}}') AS gaps,
               regexp_extract_all(text, '{_TOKEN}{{32,}}') AS fs FROM docs) WHERE len(fs) > 0))
  WHERE regexp_matches(f, '[0-9]') AND regexp_matches(f, '[a-z]') AND regexp_matches(f, '[A-Z]')"""
    wants = " OR ".join(f"(p.kind = '{k}' AND q.kind IN ({', '.join(repr(x) for x in v)}))" for k, v in PARTNERS.items())
    strong = ", ".join(repr(k) for k in STRONG)
    counts = ", ".join(f"count(s.r) FILTER (s.kind = '{k}') AS n_{k}" for k in STRONG)
    listed = "string_agg(s.kind || ':' || s.a::BIGINT || ':' || s.u::BIGINT, ',' ORDER BY s.a, s.o)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({kinds} UNION ALL {tokens}),
s AS (
  SELECT * FROM p WHERE kind IN ({strong}) OR EXISTS (
    SELECT 1 FROM p q WHERE q.r = p.r AND q.a <= p.u + {REACH} AND q.u >= p.a - {REACH} AND ({wants})))
SELECT doc_id, {counts}, sha256(coalesce({listed} FILTER (s.kind IN ({strong})), '')) AS base_sha256,
       coalesce({listed}, '') AS spans
FROM docs LEFT JOIN s USING (r) GROUP BY docs.r, doc_id
"""


SQL = _sql()

QUERIES = {"op1_secrets": Query(query, SQL)}
