"""Queries over objects and events: scans, paths, reducers, predicates, sorting, limits, display."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeglass.functions import predicates as P
from lodeglass.functions import reducers as R
from lodeglass.functions.ordering import sort_keys
from lodeglass.functions.paths import path, resolve
from lodeglass.operators import display, names
from lodeglass.operators.query import Item, Names, run
from lodeglass.plans.inputs import HEADERS, customer_table, line_objects
from lodeglass.plans.registry import Tables, query
from lodeglass.sources import sinks, snapshots

# ---- scans


@query(
    """SELECT event_id, event_type AS kind, value AS amount FROM events
       WHERE event_type = 'error' AND value > 100 ORDER BY value DESC, event_id LIMIT 10"""
)
def list_where_order_limit(t: Tables):
    return run(
        t.events,
        select=["event_id", Item("event_type", "kind"), Item("value", "amount")],
        where=lambda q: (q("kind") == "error") & (q("amount") > 100),
        order_by=[("amount", True)],
        tie=["event_id"],
        limit=10,
    )


def _parts(t: Tables):
    return t.part.select(
        F.col("p_type").alias("kind"), F.col("p_brand").alias("namespace"), F.col("p_name").alias("name"),
        "p_partkey", "p_size",
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")).alias("labels"),
    )


@query("SELECT p_partkey, p_brand AS namespace, p_name AS name FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#17'")
def list_namespace(t: Tables):
    return snapshots.list_objects(_parts(t), "ECONOMY", "Brand#17").select("p_partkey", "namespace", "name")


@query("SELECT p_partkey, p_brand AS namespace, p_name AS name FROM part WHERE p_type = 'ECONOMY'")
def list_all_namespaces(t: Tables):
    return snapshots.list_objects(_parts(t), "ECONOMY", all_namespaces=True).select("p_partkey", "namespace", "name")


@query("SELECT p_partkey, p_size FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#17' AND p_name = 'red widget'")
def get_by_key(t: Tables):
    return snapshots.get_object(_parts(t), "ECONOMY", "Brand#17", "red widget").select("p_partkey", "p_size")


@query("SELECT event_id, value FROM events WHERE event_type = 'error' AND user_id = 7")
def events_involved(t: Tables):
    events = t.events.select(
        "event_id",
        "value",
        F.struct(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("name")).alias("involvedObject"),
    )
    return snapshots.list_events(events, kind="error", name="7", all_namespaces=True).select("event_id", "value")


@query(
    """SELECT p_partkey FROM part WHERE p_brand <> 'Brand#3' AND p_size IN (1, 2, 3, 5, 8, 13) AND p_brand NOT IN ('Brand#1', 'Brand#2')"""
)
def label_select(t: Tables):
    needs = [
        P.need("brand", "!=", "Brand#3"),
        P.need("size", "in", ["1", "2", "3", "5", "8", "13"]),
        P.need("brand", "notin", ["Brand#1", "Brand#2"]),
        P.need("brand", "exists"),
        P.need("color", "!exists"),
        P.need("color", "!=", "red"),
    ]
    return _parts(t).where(P.matches_labels(F.col("labels"), needs)).select("p_partkey")


# ---- predicates


@query("SELECT p_partkey FROM part WHERE p_name LIKE 'red%' OR p_name ILIKE '%WIDGET'")
def pred_like_ilike(t: Tables):
    return t.part.where(F.col("p_name").like("red%") | F.col("p_name").ilike("%WIDGET")).select("p_partkey")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)the\s+[a-z]+ing')")
def pred_regex(t: Tables):
    return t.documents.where(F.col("text").rlike(r"(?i)the\s+[a-z]+ing")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[0-9]')")
def pred_regex_not(t: Tables):
    return t.documents.where(~F.col("text").rlike("[0-9]")).select("doc_id")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'view')")
def pred_in(t: Tables):
    return t.events.where(F.col("event_type").isin("error", "view")).select("event_id")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view')")
def pred_not_in(t: Tables):
    return t.events.where(~F.col("event_type").isin("error", "view")).select("event_id")


@query("SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 20")
def pred_between(t: Tables):
    return t.events.where(F.col("value").between(10, 20)).select("event_id", "value")


@query(
    """SELECT d.doc_id, l.quality IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)
       WHERE l.quality IS NULL OR l.toxic IS NOT NULL"""
)
def pred_null(t: Tables):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.where(F.col("quality").isNull() | F.col("toxic").isNotNull()).select(
        "doc_id", F.col("quality").isNull().alias("missing")
    )


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error' OR value > 50) AND event_type <> 'click'")
def pred_not(t: Tables):
    kind = F.col("event_type")
    return t.events.where(~((kind == "error") | (F.col("value") > 50)) & (kind != "click")).select("event_id")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS twice, CAST(l_quantity AS BIGINT) % nullif(l_linenumber - 1, 0) AS rest,
              CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) END AS share
       FROM lineitem WHERE l_quantity - l_linenumber > 40"""
)
def pred_arith(t: Tables):
    quantity, less = F.col("l_quantity"), F.col("l_linenumber") - 1
    return t.lineitem.where(quantity - F.col("l_linenumber") > 40).select(
        "l_orderkey",
        "l_linenumber",
        (quantity * 2 + 1).alias("twice"),
        P.modulo(quantity.cast("long"), less).alias("rest"),
        P.divide(quantity, less).alias("share"),
    )


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 4 * 1024")
def pred_size_literal(t: Tables):
    return t.documents.where(F.col("n_chars") > P.size("4Ki")).select("doc_id", "n_chars")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * 1048576 AS bytes FROM part WHERE p_size > 30")
def pred_size_column(t: Tables):
    sized = t.part.select("p_partkey", P.size_of(F.concat(F.col("p_size"), F.lit("Mi"))).alias("bytes"))
    return sized.where(F.col("bytes") > P.size("30Mi"))


_WORDS = "string_split(text, ' ')"


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_WORDS}, lambda w: length(w) > 20)) > 0")
def pred_any_elem(t: Tables):
    return t.documents.where(R.any_element(F.split("text", " "), lambda w: F.length(w) > 20)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({_WORDS}, lambda w: length(w) > 30)) = 0")
def pred_all_elem(t: Tables):
    return t.documents.where(R.all_elements(F.split("text", " "), lambda w: F.length(w) <= 30)).select("doc_id")


@query(
    "SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_quantity * (l_linenumber - 1) * l_linenumber / 2 > 300"
)
def pred_sum_elem(t: Tables):
    objects = line_objects(t.lineitem)
    return run(objects, select=["key", "n"], where=lambda q: q.reduced("spec.items[*].qty", "sum") > 300)


@query(
    f"""SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS words, CAST(length(lang) AS BIGINT) AS chars
        FROM documents WHERE len({_WORDS}) > 100 AND length(source) > 2"""
)
def pred_len(t: Tables):
    documents = t.documents.withColumn("words", F.split("text", " "))
    q = Names(documents)
    return documents.where((q.length("words") > 100) & (q.length("source") > 2)).select(
        "doc_id", q.length("words").alias("words"), q.length("lang").alias("chars")
    )


# ---- paths


@query(
    """SELECT 'line-' || l_orderkey || '-' || l_linenumber AS "metadata.name",
              CASE WHEN l_linestatus = 'O' THEN 'Running' ELSE 'Succeeded' END AS phase,
              CAST(NULL AS VARCHAR) AS missing, CAST(NULL AS VARCHAR) AS below
       FROM lineitem"""
)
def path_dotted(t: Tables):
    picked = run(
        line_objects(t.lineitem),
        select=[
            "metadata.name", Item("Status.Phase", "phase"), Item("status.nothing", "missing"), Item("status.phase.x", "below"),
        ],
    )
    return picked.withColumns({c: F.col(c).cast("string") for c in ("missing", "below")})


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def path_json(t: Tables):
    events = t.events.withColumn("object", F.parse_json("props"))
    return events.select("event_id", F.try_variant_get(path(events, "object.k"), "$", "bigint").alias("k"))


@query(
    """SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS n,
              CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS BIGINT) END AS qty,
              CASE WHEN l_linenumber > 6 THEN 'part-6' END AS part
       FROM lineitem"""
)
def path_index(t: Tables):
    return run(
        line_objects(t.lineitem), select=["key", "n", Item("spec.items[0].qty", "qty"), Item("spec.items[5].part", "part")]
    )


@query(
    """SELECT l_orderkey AS key, 'supp-' || l_suppkey AS app, l_returnflag AS loose,
              CAST(NULL AS VARCHAR) AS strict, CAST(NULL AS VARCHAR) AS none
       FROM lineitem"""
)
def path_map_key(t: Tables):
    return run(
        line_objects(t.lineitem),
        select=[
            "key", Item("metadata.labels['app.kubernetes.io/name']", "app"), Item("metadata.labels.tier", "loose"),
            Item("metadata.labels[tier]", "strict"), Item("metadata.labels[none]", "none"),
        ],
    )


_NUMBERS = "list_filter([1, 2, 3, 4, 5, 6, 7], lambda i: i < l_linenumber)"


@query(
    f"""SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS n,
               array_to_string(list_transform(list_filter({_NUMBERS}, lambda i: i <> 3), lambda i: l_partkey + i), ',') AS prices,
               CAST(len(list_filter({_NUMBERS}, lambda i: i <> 3)) AS BIGINT) AS hits
        FROM lineitem"""
)
def path_wildcard(t: Tables):
    objects = line_objects(t.lineitem)
    prices = path(objects, "spec.items[*].price")
    return objects.select(
        "key", "n", F.array_join(prices.cast("array<string>"), ",").alias("prices"), F.size(prices).cast("long").alias("hits")
    )


@query(
    f"""SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS n,
               array_to_string(list_transform({_NUMBERS}, lambda i: 'a' || i || ',b' || i), ',') AS tags
        FROM lineitem"""
)
def path_fanout(t: Tables):
    objects = line_objects(t.lineitem)
    return objects.select("key", "n", F.array_join(path(objects, "spec.items.tags"), ",").alias("tags"))


@query("SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def name_flexible(t: Tables):
    renamed = t.customer.withColumnsRenamed({"c_mktsegment": "Mkt Segment", "c_acctbal": "AcctBal"})
    return run(renamed, select=["c_custkey", Item("mkt_segment", "segment"), Item("acctbal", "balance")])


# ---- reducers

_KEY = "l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS n"


@query(
    f"""SELECT {_KEY}, CAST(l_quantity AS DOUBLE) * (l_linenumber - 1) * l_linenumber / 2 AS total,
               CAST(0 AS DOUBLE) AS texts FROM lineitem"""
)
def reduce_sum(t: Tables):
    items = [Item("spec.items[*].qty", "total", "sum"), Item("spec.items[*].part", "texts", "sum")]
    return run(line_objects(t.lineitem), select=["key", "n", *items])


@query(f"SELECT {_KEY}, CAST(l_linenumber - 1 AS BIGINT) AS items FROM lineitem WHERE l_linenumber > 3")
def reduce_len(t: Tables):
    return run(
        line_objects(t.lineitem),
        select=["key", "n", Item("spec.items", "items", "len")],
        where=lambda q: q("items") > 2,
    )


@query(f"SELECT {_KEY}, l_linenumber > 2 AS some, FALSE AS texts FROM lineitem")
def reduce_any(t: Tables):
    items = [Item("spec.items[*].ret", "some", "any"), Item("spec.items[*].part", "texts", "any")]
    return run(line_objects(t.lineitem), select=["key", "n", *items])


@query(
    f"""SELECT {_KEY}, l_linenumber > 1 AND l_linenumber < 6 AND (l_returnflag = 'R' OR l_linenumber < 4) AS every,
               FALSE AS mixed FROM lineitem"""
)
def reduce_all(t: Tables):
    """Flags of one to six elements: true, false and, from the fifth on, one NULL; the first line of an order has none."""
    numbers = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: i < F.col("l_linenumber"))
    flag = lambda i: F.when((i == 4) & (F.col("l_linenumber") > 5), F.lit(None)).otherwise(
        (i < 3) | (F.col("l_returnflag") == "R")
    )
    objects = line_objects(t.lineitem.withColumn("flags", F.transform(numbers, flag)), "flags")
    return run(
        objects, select=["key", "n", Item("flags", "every", "all"), Item("spec.items[*].ret", "mixed", "all")]
    )


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x > -0.25 AS INTEGER))) = len(embedding) AS positive, len(embedding) > 0 AND list_max(embedding) > 0.3 AS high FROM embeddings")
def reduce_flags(t: Tables):
    flags = t.embeddings.select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double") > -0.25).alias("signs"),
        F.transform("embedding", lambda x: x.cast("double") > 0.3).alias("highs"),
    )
    return run(flags, select=["vec_id", Item("signs", "positive", "all"), Item("highs", "high", "any")])


@query(f"SELECT {_KEY}, l_tax AS tax FROM lineitem")
def reduce_scalar(t: Tables):
    return run(line_objects(t.lineitem), select=["key", "n", Item("status.tax", "tax", "sum")])


# ---- sort and limit

_MIXED = """CASE WHEN p_size < 10 THEN CAST(p_size AS VARCHAR) WHEN p_size < 20 THEN p_size || '.5'
                 WHEN p_size < 30 THEN p_type WHEN p_size < 49 THEN '0' || p_size END"""
_MIXED_NUMBER = f"TRY_CAST(({_MIXED}) AS DOUBLE)"


def _mixed(t: Tables):
    size, text = F.col("p_size"), F.col("p_size").cast("string")
    mixed = (
        F.when(size < 10, text)
        .when(size < 20, F.concat(text, F.lit(".5")))
        .when(size < 30, F.col("p_type"))
        .when(size < 49, F.concat(F.lit("0"), text))
    )
    return t.part.select("p_partkey", "p_brand", mixed.alias("mixed"))


def _ranked(t: Tables, descending: bool):
    """Every part's place among those of its brand, so that the order is data."""
    mixed = _mixed(t)
    order = sort_keys(resolve(mixed, "mixed"), descending)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(*order, "p_partkey"))
    return mixed.select("p_partkey", "p_brand", "mixed", place.alias("place"))


@query(
    f"""SELECT p_partkey, p_brand, {_MIXED} AS mixed, row_number() OVER (PARTITION BY p_brand
          ORDER BY ({_MIXED}) IS NOT NULL, {_MIXED_NUMBER} IS NULL, {_MIXED_NUMBER},
                   CASE WHEN {_MIXED_NUMBER} IS NULL THEN {_MIXED} END, p_partkey) AS place FROM part"""
)
def sort_numeric_text(t: Tables):
    return _ranked(t, descending=False)


@query(
    f"""SELECT p_partkey, p_brand, {_MIXED} AS mixed, row_number() OVER (PARTITION BY p_brand
          ORDER BY ({_MIXED}) IS NULL, {_MIXED_NUMBER} IS NOT NULL, {_MIXED_NUMBER} DESC,
                   CASE WHEN {_MIXED_NUMBER} IS NULL THEN {_MIXED} END DESC, p_partkey) AS place FROM part"""
)
def sort_numeric_text_desc(t: Tables):
    return _ranked(t, descending=True)


@query(
    """SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS n, l_tax AS tax FROM lineitem
       ORDER BY l_linenumber DESC, l_tax, l_orderkey LIMIT 100"""
)
def sort_by_reducer(t: Tables):
    return run(
        line_objects(t.lineitem),
        select=["key", "n", Item("status.tax", "tax"), Item("spec.items", "size", "len")],
        order_by=[("size", True), "tax"],
        tie=["key"],
        limit=100,
    ).drop("size")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def limit_twice(t: Tables):
    return run(
        t.orders, select=["o_orderkey", "o_totalprice"], order_by=[("o_totalprice", True)], tie=["o_orderkey"],
        limit=50, row_limit=20,
    )


@query("SELECT p_partkey FROM part WHERE FALSE")
def limit_zero(t: Tables):
    return run(t.part, select=["p_partkey"], order_by=["p_name"], limit=0)


# ---- rows and display


def _items(t: Tables):
    return display.shape_rows(customer_table(t.customer), HEADERS)


@query(
    """SELECT c_name AS name, 'ns-' || c_nationkey AS namespace, c_mktsegment AS phase, c_acctbal AS balance,
              CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_custkey AS VARCHAR) END AS age FROM customer"""
)
def row_shape(t: Tables):
    return run(
        _items(t),
        select=["name", "namespace", Item("status.phase", "phase"), Item("status.balance", "balance"), Item("_columns.age", "age")],
    )


@query("SELECT c_mktsegment AS phase, c_name AS name, 'ns-' || c_nationkey AS namespace FROM customer")
def drop_internal(t: Tables):
    return display.strip_internal(_items(t)).select("status.phase", "metadata.name", "metadata.namespace")


@query(
    """SELECT c_name AS "Name", 'ns-' || c_nationkey AS "Namespace", c_mktsegment AS "Mkt Segment",
              CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS "Age" FROM customer"""
)
def namespace_inject(t: Tables):
    return display.display(_items(t), HEADERS, all_namespaces=True)


@query(
    """SELECT c_name AS "Name", c_mktsegment AS "Mkt Segment",
              CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS "Age" FROM customer"""
)
def display_cells(t: Tables):
    return display.display(_items(t), HEADERS)


@query(
    """SELECT c_name AS "Name", c_mktsegment AS "Mkt Segment",
              CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS "Age" FROM customer
       ORDER BY lower(c_mktsegment), c_name LIMIT 40"""
)
def sort_display(t: Tables):
    return display.display(_items(t), HEADERS, sort_by="mkt segment", row_limit=40, tie=["name"])


@query(
    """SELECT '{"id":' || event_id || ',"kind":"' || event_type || '","n":{"a":' || user_id || '}'
              || CASE WHEN event_type = 'error' THEN '' ELSE ',"type":"' || event_type || '"' END || '}' AS json FROM events"""
)
def json_rows(t: Tables):
    kind = F.col("event_type")
    rows = t.events.select(
        F.when(kind != "error", kind).alias("type"),
        F.struct(F.lit(None).cast("string").alias("z"), F.col("user_id").alias("a")).alias("n"),
        kind.alias("kind"),
        F.col("event_id").alias("id"),
    )
    return sinks.json_rows(rows)


# ---- names

_NATIONS = """SELECT lower(n_name) || 's' AS plural, lower(n_name) AS singular, 'n' || n_nationkey AS short,
                     lower(r_name) AS grp, n_nationkey AS pos FROM nation JOIN region ON n_regionkey = r_regionkey"""


@query(
    f"""WITH api AS ({_NATIONS}),
        asked AS (SELECT c_custkey, c_mktsegment, c_nationkey, lower(r_name) AS grp
                  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE plural END AS resource,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE api.grp END AS "group"
        FROM asked JOIN api ON pos = c_nationkey"""
)
def resource_alias(t: Tables):
    region = F.lower("r_name")
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    api = nations.select(
        F.col("n_nationkey").alias("pos"), region.alias("group"), F.lit("v1").alias("version"),
        F.concat(F.lower("n_name"), F.lit("s")).alias("name"), F.lower("n_name").alias("singular"),
        F.array(F.concat(F.lit("n"), F.col("n_nationkey"))).alias("short_names"),
    )
    segment, nation = F.col("c_mktsegment"), F.col("n_name")
    request = (
        F.when(segment == "MACHINERY", F.concat(F.lower(nation), F.lit(".nowhere")))
        .when(segment == "BUILDING", F.concat(nation, F.lit("S")))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("n"), F.col("n_nationkey")))
        .when(segment == "FURNITURE", F.concat(nation, F.lit("."), F.col("r_name")))
        .otherwise(F.lower(nation))
    )
    asked = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", request.alias("request"))
    return names.resolve_resources(asked, api).select("c_custkey", "resource", "group")


@query(
    """SELECT o_orderkey,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'Deployment' WHEN '2-HIGH' THEN 'StatefulSet'
                   WHEN '3-MEDIUM' THEN NULL WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Job' END AS kind,
              CASE o_orderpriority WHEN '3-MEDIUM' THEN 'pod-' || o_orderkey WHEN '4-NOT SPECIFIED' THEN 'a/' || o_orderkey
                   ELSE CAST(o_orderkey AS VARCHAR) END AS name
       FROM orders"""
)
def kind_alias(t: Tables):
    key, priority = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    reference = (
        F.when(priority == "1-URGENT", F.concat(F.lit("Deploy/"), key))
        .when(priority == "2-HIGH", F.concat(F.lit("sts/"), key))
        .when(priority == "3-MEDIUM", F.concat(F.lit("pod-"), key))
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit("cronjob/a/"), key))
        .otherwise(F.concat(F.lit("jobs/"), key))
    )
    kind, name = names.split_reference(reference)
    return t.orders.select("o_orderkey", names.canonical_kind(kind).alias("kind"), name.alias("name"))
