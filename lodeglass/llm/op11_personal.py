"""Personal data by weak supervision: labelers vote on spans, their votes are weighed, and a classifier learns from them.

Patterns propose spans. Labelers of three sorts vote on each span, for, against or not at all: the pattern's own check, a
gazetteer (domains, country and issuer codes, given names), and the context (cue words before it, words that speak
against it, what it touches). Spans with the same votes are one row, so the votes of any corpus are a table of bounded
size. On it expectation-maximisation estimates how often each kind is right and how reliable each labeler is, in one
fold over an array. The resulting probabilities are the labels from which a logistic regression over votes and shape of
the spans is trained. It decides about spans that no strict pattern settles.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeglass.functions.text import let
from lodeglass.llm.common import Query, stage, table

# Patterns are possessive and anchored at the start of a run, so that long runs are read once and without recursion. A
# match that starts further left is the same for every start in its run; ``\G`` is where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
#: Base kinds in order. A match that fails its check uses up its text.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Given names and titles that propose a person's name; ``find_personal`` takes other ones.
GIVEN_NAMES = (
    "Alexander", "Alice", "Andrea", "Angela", "Anna", "Anne", "Antonio", "Barbara", "Carlos", "Carmen", "Charles",
    "Christine", "Claire", "Daniel", "David", "Elena", "Elizabeth", "Emma", "Eva", "Francisco", "George", "Hans",
    "Isabel", "James", "Jane", "Jean", "Jennifer", "John", "Jose", "Juan", "Julia", "Karen", "Karl", "Laura", "Linda",
    "Louis", "Lucia", "Manuel", "Maria", "Marie", "Mark", "Martin", "Mary", "Michael", "Nicolas", "Patricia", "Paul",
    "Peter", "Pierre", "Richard", "Robert", "Sarah", "Sofia", "Susan", "Thomas", "Ursula", "William",
)
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")


def kinds(names: tuple[str, ...] = GIVEN_NAMES) -> dict[str, str]:
    """All kinds in order: the base ones, then those that need the classifier's consent."""
    word = r"\p{Lu}[\p{L}'-]++"
    person = rf"(?<![\p{{L}}\p{{M}}])(?:(?:{'|'.join(TITLES)})\.?\x20(?:{word}\x20)?|(?:{'|'.join(names)})\x20){word}"
    return BASE | {
        "name": person,
        "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
        r"|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        # not the end of a number that begins with a country code
        "local": r"(?<![0-9])(?<!\+[0-9][\x20().0-9-]{0,10})(?<!\+)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    }


#: Cheap tests that a text has to pass before a pattern is tried.
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "name": " ", "id": "", "local": "", "card": ""}
# Top-level domains, country codes and card issuers that count as known; networks of no person.
_DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl|ch|at|be|pt|se|no|dk|fi|pl|us|ca|au|jp|br|mx|in)$"
_COUNTRIES = r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|9[679][0-9])"
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
_NO_PERSON = r"^(?:0|10|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5]|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
_CUES = {
    "email": r"(?i)(?:mail|contact|write to|reach|from|cc)",
    "ip": r"(?i)(?:\bip\b|address|host|client|login from|connected)",
    "card": r"(?i)(?:card|visa|amex|credit|account|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|whatsapp)",
    "name": r"(?i)(?:name|contact|signed|dear|regards|born|patient|customer|employee|author|by|with)",
    "id": r"(?i)(?:ssn|social security|iban|account|passport|tax id|identity|insurance)",
    "local": r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|whatsapp)",
}
_AGAINST = r"(?i)(?:version|build|release|isbn|issn|order|invoice|figure|table|page|section|serial|model|sku|item|chapter|https?:|www\.)"
_NOT_PEOPLE = r"\x20(?i:street|avenue|university|school|hospital|inc|ltd|gmbh|prize|award|institute|airport)\b"

LABELERS = ("check", "gazetteer", "cue", "against", "edges", "variety")
#: Votes as they are kept: none, for, against; the last one where a labeler has nothing to say on a kind.
NONE, FOR, AGAINST, UNASKED = 0, 1, 2, 3
#: Code points of the gap before and after a span that are context.
BEFORE, AFTER = 40, 16
#: Rounds of expectation-maximisation, pseudo-counts of its estimates, and how sure a label can be.
ROUNDS, PRIOR, SUREST = 25, 1.0, 0.999


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether ``digits`` (a few) have the check digit that their others ask for."""

    def part(x: Column, k: Column) -> Column:
        n = x.cast("int")
        return F.when(k % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    parts = F.transform(F.split(F.reverse(digits), ""), part)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _iban(text: Column) -> Column:
    """Whether the number that an account number spells leaves 1 when divided by 97."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _passes(kind: str, text: Column) -> Column:
    """A base kind's own check."""
    if kind == "ip":
        octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return text.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    if kind == "card":
        return let(_digits(text), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def _vote(good: Column | bool, bad: Column | bool) -> Column:
    return F.when(F.lit(bad) if isinstance(bad, bool) else bad, AGAINST).when(
        F.lit(good) if isinstance(good, bool) else good, FOR
    ).otherwise(NONE)


def _votes(kind: str, text: Column, before: Column, after: Column) -> Column:
    """One vote per labeler."""
    spelled = text.rlike("^[A-Z]")
    unasked = F.lit(UNASKED)
    check = {
        "name": unasked,
        "id": F.when(spelled, _vote(_iban(text), ~_iban(text))).otherwise(_vote(False, text.rlike("^(?:000|666|9)|-00-|-0000$"))),
        "local": _vote(False, _digits(text).rlike("^[01]|^...[01]")),
    }.get(kind, _vote(_passes(kind, text), ~_passes(kind, text)))
    gazetteer = {
        "email": _vote(text.rlike(_DOMAINS), False),
        "ip": _vote(False, text.rlike(_NO_PERSON)),
        "card": _vote(_digits(text).rlike(_ISSUERS), ~_digits(text).rlike(_ISSUERS)),
        "phone": _vote(text.rlike(_COUNTRIES), ~text.rlike(_COUNTRIES)),
        "name": _vote(True, text.rlike(_NOT_PEOPLE)),
        "id": unasked,
        "local": unasked,
    }[kind]
    against = before.rlike(_AGAINST)
    if kind == "name":
        against = against | after.rlike(_NOT_PEOPLE)
    touched = before.rlike(r"[\p{L}0-9_/=#]$") | after.rlike(r"^[\p{L}0-9_/=]")
    kinds_of_digit = F.size(F.array_distinct(F.split(F.left(_digits(text), F.lit(64)), "")))
    variety = _vote(kinds_of_digit >= 4, kinds_of_digit <= 2) if kind not in ("email", "name") else unasked
    return F.array(check, gazetteer, _vote(before.rlike(_CUES[kind]), False), _vote(False, against), _vote(False, touched), variety)


def _shape(text: Column, before: Column) -> Column:
    """What else the classifier sees, in few steps: length, share of digits, separators, and whether a line begins here."""
    size = F.length(text)
    return F.array(
        F.least(F.floor(F.log2(size)).cast("int"), F.lit(6)),
        F.floor(F.length(_digits(F.left(text, F.lit(64)))) * 4 / F.least(size, F.lit(64))).cast("int"),
        F.when(text.rlike(r"[\x20().-]"), 1).otherwise(0),
        F.when((before == "") | before.endswith("\n"), 1).otherwise(0),
    )


def _runs(text: Column, kind: str, pattern: str) -> Column:
    """Gap before, length, check, votes and shape of each match, leftmost first and not overlapping.

    ``split`` and ``regexp_extract_all`` walk the same matches, so gaps and matches alternate.
    """

    def described(gaps: Column, found: Column, k: Column) -> Column:
        before = F.right(F.get(gaps, k), F.lit(BEFORE))
        after = F.left(F.get(gaps, k + 1), F.lit(AFTER))
        return F.struct(
            F.length(F.get(gaps, k)).alias("gap"),
            F.length(found).alias("n"),
            (_passes(kind, found) if kind in BASE else F.lit(False)).alias("sure"),
            _votes(kind, found, before, after).alias("votes"),
            _shape(found, before).alias("shape"),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = let(F.split(text, pattern, -1), lambda gaps: F.transform(found, lambda x, k: described(gaps, x, k)))
    none = F.array().cast("array<struct<gap:int,n:int,sure:boolean,votes:array<int>,shape:array<int>>>")
    return F.when(text.contains(_NEEDS[kind]) & text.rlike(pattern), rows).otherwise(none)


def estimate(patterns: Column, n_kinds: int) -> Column:
    """Estimates from ``patterns``, an array of kind (a number), votes and n, by expectation-maximisation.

    ``right`` has the share of true spans per kind, ``theta`` per labeler the chances of each vote on a false span, then
    of each on a true one. Labelers are as reliable on one kind as on another; one that a kind does not ask is no evidence
    (the chance of that is put as 1). Starts from the votes' majority.
    """

    def odds(p: Column, state: Column) -> Column:
        prior = F.get(state["right"], p["kind"])
        each = F.zip_with(p["votes"], state["theta"], lambda v, t: F.log(F.get(t, v + 4) / F.get(t, v)))
        return F.aggregate(each, F.log(prior / (1 - prior)), lambda a, x: a + x)

    def total(of: Column, chosen) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda a, x: a + F.when(chosen(x), x["w"]).otherwise(0.0))

    def weighed(chance) -> Column:
        """Patterns with the weight of their true (1) and of their false spans (0)."""
        both = lambda p, c: F.array(
            *[F.struct(F.lit(y).alias("y"), p["kind"].alias("kind"), p["votes"].alias("votes"), w.alias("w")) for y, w in ((0, p["n"] * (1 - c)), (1, p["n"] * c))]
        )
        return F.flatten(F.transform(patterns, lambda p: let(chance(p), lambda c: both(p, c))))

    def maximised(of: Column) -> Column:
        def right(kind: Column) -> Column:
            good = total(of, lambda x: (x["kind"] == kind) & (x["y"] == 1))
            return (good + PRIOR) / (total(of, lambda x: x["kind"] == kind) + 2 * PRIOR)

        def theta(labeler: Column) -> Column:
            cast = lambda y, v: total(of, lambda x: (x["y"] == y) & (F.get(x["votes"], labeler) == v)) + PRIOR
            all_of = lambda y: F.array(*[cast(y, v) for v in (NONE, FOR, AGAINST)])
            shares = lambda n: F.transform(n, lambda x: x / F.aggregate(n, F.lit(0.0), lambda a, y: a + y))
            return F.concat(*[F.concat(let(all_of(y), shares), F.array(F.lit(1.0))) for y in (0, 1)])

        return F.struct(
            F.transform(F.sequence(F.lit(0), F.lit(n_kinds - 1)), right).alias("right"),
            F.transform(F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)), theta).alias("theta"),
        )

    logistic = lambda x: 1 / (1 + F.exp(-x))
    majority = lambda p: logistic(
        F.aggregate(p["votes"], F.lit(0.0), lambda a, v: a + F.when(v == FOR, 1.0).when(v == AGAINST, -1.0).otherwise(0.0))
    )
    start = let(weighed(majority), maximised)
    step = lambda state, _: let(weighed(lambda p: logistic(odds(p, state))), maximised)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _chance(estimates) -> Column:
    """The probability that a span of ``kind`` (a number) with ``votes`` is true, by the ``estimates``."""
    right = F.array(*map(F.lit, estimates["right"]))
    prior = F.get(right, F.col("kind"))
    odds = F.log(prior / (1 - prior))
    for k, theta in enumerate(estimates["theta"]):
        ratio = F.array(*[F.lit(theta[v + 4] / theta[v]) for v in range(4)])
        odds = odds + F.log(F.get(ratio, F.get("votes", F.lit(k))))
    return 1 / (1 + F.exp(-odds))


def _features(n_kinds: int) -> dict[str, Column]:
    """Numbers between 0 and 1 about a span of ``kind`` (a number), ``votes`` and ``shape``."""
    out = {f"kind{k}": F.col("kind") == k for k in range(n_kinds)}
    for k, name in enumerate(LABELERS):
        out |= {f"{name}{v}": F.get("votes", F.lit(k)) == v for v in (FOR, AGAINST)}
    out = {name: F.when(test, 1.0).otherwise(0.0) for name, test in out.items()}
    return out | {f"shape{k}": F.get("shape", F.lit(k)) / float(most) for k, most in enumerate((6, 4, 1, 1))}


def learn(spans: DataFrame, n_kinds: int) -> Column | None:
    """The classifier's verdict on a span of ``kind``, ``votes`` and ``shape``, trained on ``spans``; None without any.

    Equal spans are counted first. What is collected for the fold is a row per combination of kind and votes, and what the
    regression reads a row per combination of kind, votes and shape, whatever the size of the corpus.
    """
    patterns = stage(spans.groupBy("kind", "votes", "shape").agg(F.count("*").cast("double").alias("n")))
    if patterns.isEmpty():
        return None
    by_votes = patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    listed = by_votes.agg(F.array_sort(F.collect_list(F.struct("kind", "votes", "n"))).alias("patterns"))
    estimates = listed.select(estimate(F.col("patterns"), n_kinds).alias("e")).first()["e"]
    chance = F.least(F.greatest(_chance(estimates), F.lit(1 - SUREST)), F.lit(SUREST))
    features = _features(n_kinds)
    # one sorted partition: the same sums in the same order each time
    labelled = patterns.select("*", chance.alias("chance")).repartition(1).sortWithinPartitions("kind", "votes", "shape")
    labelled = labelled.select(*[c.alias(n) for n, c in features.items()], F.inline(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("chance")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("chance"))).alias("weight")),
    )))
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(labelled)
    model = LogisticRegression(weightCol="weight", regParam=0.001, standardization=False, maxIter=60).fit(assembled)
    score = F.lit(float(model.intercept))
    for weight, feature in zip(model.coefficients.toArray().tolist(), features.values(), strict=True):
        score = score + feature * weight
    return score > 0


def find_personal(
    docs: DataFrame, ids: list[str], text: str = "text", names: tuple[str, ...] = GIVEN_NAMES
) -> DataFrame:
    """``ids`` of every row, and ``spans``: kind, start and end (code points, end exclusive) by start, then kind.

    Base spans are those of the base patterns that pass their checks. Names, identity and account numbers and phone
    numbers without a country code are added where the classifier, trained on all spans of ``docs``, takes them for true.
    Null and empty texts have no spans. Each row is searched by itself, so equal rows get equal spans and ids may be null
    or repeat; a text of any length is searched whole. No documents give no rows. Other columns are left out, whatever
    their names.
    """
    t = F.col(f"`{text}`")
    listed = kinds(names)
    found = F.array(*[_runs(t, kind, pattern) for kind, pattern in listed.items()])
    found = F.transform(found, lambda runs, kind: F.struct(kind.alias("kind"), runs.alias("runs")))
    row = F.struct(*[F.col(f"`{c}`") for c in ids]).alias("row")
    some = F.filter(found, lambda x: F.size(x["runs"]) > 0)
    keyed = stage(docs.select(row, F.monotonically_increasing_id().alias("key"), F.coalesce(some, F.array().cast(
        "array<struct<kind:int,runs:array<struct<gap:int,n:int,sure:boolean,votes:array<int>,shape:array<int>>>>>"
    )).alias("found")))
    runs = keyed.where(F.size("found") > 0).select("key", F.inline("found"))
    runs = runs.select("key", "kind", F.posexplode("runs").alias("k", "run")).select("key", "kind", "k", "run.*")
    accepted = learn(runs, len(listed))
    w = Window.partitionBy("key", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    until = F.sum(F.col("gap").cast("long") + F.col("n")).over(w)
    kept = F.col("sure") | ((F.col("kind") >= len(BASE)) & (F.lit(False) if accepted is None else accepted))
    spans = runs.withColumn("until", until).where(kept)
    spans = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((F.col("until") - F.col("n")).alias("at"), "kind", "until"))).alias("s"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    named = F.array(*map(F.lit, listed))
    tidy = F.transform("s", lambda x: F.struct(F.get(named, x["kind"]).alias("kind"), x["at"].alias("start"), x["until"].alias("end")))
    return keyed.join(spans, "key", "left").select("row.*", F.coalesce(tidy, none).alias("spans"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal(table(spark, folder, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


QUERIES = {"op11_personal": Query(query)}
