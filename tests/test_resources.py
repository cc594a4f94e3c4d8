"""Paths, reducers, predicates, sorting, row shaping and names, on typed and on VARIANT columns."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lodeglass.functions import predicates as P
from lodeglass.functions import reducers as R
from lodeglass.functions.paths import match_name, path, resolve
from lodeglass.functions.values import float_text
from lodeglass.operators import display, logs, names, picks
from lodeglass.operators.query import Item, Names, run
from lodeglass.sources import sinks

OBJECTS = [
    {
        "id": 1,
        "metadata": {"name": "a", "labels": {"app.kubernetes.io/name": "x", "Tier": "web", "Last Seen": "now"}},
        "items": [
            {"n": 1, "ok": True, "tags": ["p", "q"], "sub": [{"v": 1}, {"v": None}]},
            {"n": None, "ok": None, "tags": None, "sub": []},
            {"n": 3.5, "ok": True, "tags": [], "sub": [{"v": 2}]},
        ],
        "flags": [True, True],
        "scalar": 7,
        "text": "hello",
    },
    {"id": 2, "metadata": {"name": "b", "labels": {}}, "items": [], "flags": [], "scalar": None, "text": None},
    {"id": 3, "metadata": None, "items": None, "flags": [True, None], "scalar": 9, "text": "Ä"},
]
SCHEMA = """id long, metadata struct<name:string,labels:map<string,string>>,
    items array<struct<n:double,ok:boolean,tags:array<string>,sub:array<struct<v:long>>>>,
    flags array<boolean>, scalar long, text string"""


@pytest.fixture(scope="module")
def typed(spark):
    lines = spark.createDataFrame([(json.dumps(o),) for o in OBJECTS], "j string")
    return lines.select(F.from_json("j", SCHEMA).alias("o")).select("o.*")


@pytest.fixture(scope="module")
def dynamic(spark):
    lines = spark.createDataFrame([(o["id"], json.dumps(o)) for o in OBJECTS], "id long, j string")
    return lines.select("id", F.parse_json("j").alias("o"))


PATHS = {
    "metadata.name": ["a", "b", None],
    "{{ .metadata.NAME }}": ["a", "b", None],
    "metadata.labels['app.kubernetes.io/name']": ["x", None, None],
    "metadata.labels.tier": ["web", None, None],
    "metadata.labels[tier]": [None, None, None],
    "metadata.labels.last_seen": ["now", None, None],
    "missing.x": [None, None, None],
    "scalar.x": [None, None, None],
    "items[0].n": [1, None, None],
    "items[9].n": [None, None, None],
    "scalar[0]": [None, None, None],
    "items[*].n": [[1, 3.5], [], None],
    "items.n": [[1, 3.5], [], None],
    "items[*].tags": [["p", "q"], [], None],
    "items.sub.v": [[1, 2], [], None],
    "items[*].sub[0].v": [[1, 2], [], None],
    "items[*].none": [[], [], None],
    "scalar[*]": [None, None, None],
    "flags[*]": [[True, True], [], [True]],
    "text": ["hello", None, "Ä"],
}


def as_json(column):
    return F.when(column.isNotNull(), F.to_json(F.struct(column.alias("v"))))


def value_of(text):
    return None if text is None else json.loads(text).get("v")


def collected(df, columns):
    """Values of many columns by row id, from one job."""
    rows = df.select("id", *[as_json(c).alias(f"v{i}") for i, c in enumerate(columns)]).orderBy("id").collect()
    return [[value_of(r[i + 1]) for r in rows] for i in range(len(columns))]


def test_typed_paths(typed):
    got = collected(typed, [path(typed, text) for text in PATHS])
    assert dict(zip(PATHS, got)) == PATHS


@pytest.mark.parametrize("text", [t for t in PATHS if not t.startswith("{{")])
def test_variant_paths(dynamic, text):
    assert collected(dynamic, [path(dynamic, "o." + text)]) == [PATHS[text]]


def test_match_name():
    assert match_name(["Last Seen", "last_seen"], "last_seen") == "last_seen"
    assert match_name(["Last Seen", "LAST_SEEN"], "last_seen") == "LAST_SEEN"
    assert match_name(["Last Seen"], "last_seen") == "Last Seen"
    assert match_name(["a"], "b") is None


REDUCED = {
    ("items[*].n", "sum"): [4.5, 0.0, None],
    ("items", "len"): [3, 0, None],
    ("flags", "any"): [True, False, True],
    ("flags", "all"): [True, False, False],
    ("items[*].ok", "all"): [True, False, None],
    ("items[*].tags", "sum"): [0.0, 0.0, None],
    ("scalar", "sum"): [7, None, 9],
    ("text", "len"): ["hello", None, "Ä"],
}


@pytest.mark.parametrize("form", ["typed", "dynamic"])
def test_reducers(request, form):
    df, prefix = request.getfixturevalue(form), "" if form == "typed" else "o."
    for (text, reducer), wanted in REDUCED.items():
        assert collected(df, [R.reduce_value(resolve(df, prefix + text), reducer).column]) == [wanted]
    with pytest.raises(ValueError):
        R.reduce_value(resolve(df, prefix + "items"), "median")


def test_reducers_match_model(spark):
    rng = random.Random(1)
    values = [[rng.choice([True, False, None]) for _ in range(rng.randrange(5))] for _ in range(60)]
    numbers = [[rng.choice([1.5, -2.0, None]) for _ in range(rng.randrange(5))] for _ in range(60)]
    rows = [(i, v, n) for i, (v, n) in enumerate(zip(values, numbers))]
    df = spark.createDataFrame(rows, "id int, f array<boolean>, n array<double>")
    q = Names(df)
    got = df.select(
        "id", q.reduced("f", "any").alias("any"), q.reduced("f", "all").alias("all"),
        q.reduced("n", "sum").alias("sum"), q.reduced("n", "len").alias("len"),
    ).orderBy("id").collect()
    for r in got:
        v, n = values[r.id], numbers[r.id]
        assert (r.any, r.all) == (any(x is True for x in v), bool(v) and all(x is True for x in v))
        assert (r.sum, r.len) == (sum(x for x in n if x is not None), len(n))


def test_element_conditions_and_length(typed):
    q = Names(typed)
    rows = typed.select(
        "id",
        R.any_element(q("items"), lambda x: x["n"] > 2).alias("some"),
        R.all_elements(q("items"), lambda x: x["n"] > 0).alias("every"),
        q.length("items").alias("items"), q.length("text").alias("text"), q.length("metadata.labels").alias("labels"),
    ).orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == [
        (True, False, 3, 5, 3), (False, False, 0, None, 0), (False, False, None, 1, None)
    ]


def test_query_clauses(typed):
    out = run(
        typed,
        select=[Item("metadata.name", "who"), Item("items", "size", "len"), "scalar"],
        where=lambda q: q("size") >= 0,
        order_by=[("size", True)],
        tie=["id"],
    )
    assert [tuple(r) for r in out.collect()] == [("a", 3, 7), ("b", 0, None)]
    assert out.columns == ["who", "size", "scalar"]
    assert run(typed, limit=0).count() == 0
    assert run(typed, limit=2, row_limit=1).count() == 1
    assert run(typed, where=F.col("scalar") > 8).count() == 1


def test_numeric_text_order(spark):
    values = ["10", "9", "9.5", None, "abc", "Z", "1e1", "5d", " 5", "+3", "", "9007199254740993", "9007199254740992", "inf"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    up = [None, "+3", "9", "9.5", "10", "1e1", "9007199254740992", "9007199254740993", "", " 5", "5d", "Z", "abc", "inf"]
    got = [r.v for r in run(df, order_by=["v"], tie=["id"]).collect()]
    # A number without an exact whole form comes before the same number with one.
    assert sorted(got[4:6]) == ["10", "1e1"] and got[:4] + got[6:] == up[:4] + up[6:]
    down = [r.v for r in run(df, order_by=[("v", True)], tie=["id"]).collect()]
    assert down[-1] is None and down[0] == "inf" and down[5:8] == ["", "9007199254740993", "9007199254740992"]


def test_predicates(spark):
    df = spark.createDataFrame([("512Mi",), ("1.5Ki",), ("7",), ("x",), ("Mi",)], "t string")
    assert [r.b for r in df.select(P.size_of(F.col("t")).alias("b")).collect()] == [536870912.0, 1536.0, 7.0, None, None]
    row = spark.range(1).select(
        P.size("4Gi").alias("g"), P.size("2Pi").alias("p"), P.divide(F.lit(1), F.lit(0)).alias("d"), P.modulo(F.lit(7), F.lit(0)).alias("m")
    ).first()
    assert tuple(row) == (4 * 1024**3, 2 * 1024**5, None, None)
    assert [P.duration_seconds(x) for x in ("1h", "30m", "1h30m", "1.5s", "500ms")] == [3600, 1800, 5400, 1, 0]
    for bad in ("", "5", "1x", "h"):
        with pytest.raises(ValueError):
            P.duration_seconds(bad)
    with pytest.raises(ValueError):
        P.matches_labels(F.lit(None), [P.need("a", "~")])


def test_label_conditions(spark):
    df = spark.createDataFrame([(1, {"a": "x"}), (2, {"a": "y", "b": "z"}), (3, {}), (4, None)], "id int, labels map<string,string>")

    def ids(*needs):
        return sorted(r.id for r in df.where(P.matches_labels(F.col("labels"), needs)).collect())

    assert ids(P.need("a", "=", "x")) == [1]
    assert ids(P.need("a", "!=", "x")) == [2, 3, 4]
    assert ids(P.need("a", "in", ["x", "y"]), P.need("b")) == [2]
    assert ids(P.need("a", "notin", ["x", "y"])) == [3, 4]
    assert ids(P.need("b", "!exists")) == [1, 3, 4]
    assert ids() == [1, 2, 3, 4]


def test_rows_and_display(spark):
    schema = "object struct<metadata:struct<name:string,namespace:string>,name:string,x:int>, cells array<string>"
    rows = [((("a", "n1"), "own", 1), ["a", "Up", "5d"]), (((None, None), "kept", 2), ["B", "down"])]
    table = spark.createDataFrame(rows, schema)
    headers = ["Name", "Status", "Age"]
    items = display.shape_rows(table, headers)
    assert [(r.name, r.namespace, r._columns) for r in items.orderBy("x").collect()] == [
        ("a", "n1", {"Name": "a", "Status": "Up", "Age": "5d"}), ("kept", None, {"Name": "B", "Status": "down"})
    ]
    assert display.strip_internal(items).columns == ["metadata", "x"]
    shown = display.display(items, headers, sort_by="NAME", all_namespaces=True, tie=["x"])
    assert [tuple(r) for r in shown.collect()] == [("a", "n1", "Up", "5d"), ("B", "", "down", "")]
    assert display.inject_namespace(["x", "NAMESPACE"], items)[0] == ["x", "NAMESPACE"]
    assert display.inject_namespace(["x"], items)[0] == ["Namespace", "x"]
    assert display.display(items, headers, sort_by="nothing").count() == 2
    assert display.display(items, headers, row_limit=1).count() == 1


def test_json_rows(spark):
    df = spark.createDataFrame([(1, None, {"z": "1", "a": "2"}, (None, "v"))], "b int, a string, m map<string,string>, s struct<y:string,x:string>")
    assert sinks.json_rows(df).first().json == '{"b":1,"m":{"a":"2","z":"1"},"s":{"x":"v"}}'
    assert sinks.json_rows(df.where("b > 1")).count() == 0


def test_resource_names(spark):
    api = spark.createDataFrame(
        [(0, "", "v1", "pods", "pod", ["po"]), (1, "apps", "v1", "deployments", "deployment", ["deploy"]),
         (2, "metrics.k8s.io", "v1", "pods", "", None)],
        "pos int, group string, version string, name string, singular string, short_names array<string>",
    )
    asked = {"PODS": ("", "pods"), "po": ("", "pods"), "Pods.metrics.k8s.io": ("metrics.k8s.io", "pods"),
             "deploy.APPS": ("apps", "deployments"), "pods.none": None, "x": None, "pod.": ("", "pods")}
    got = names.resolve_resources(spark.createDataFrame([(a,) for a in asked], "request string"), api).collect()
    assert {r.request: (r.group, r.resource) if r.resource else None for r in got} == asked


def test_references(spark):
    texts = {"Deploy/web": ("Deploy", "web", "Deployment"), "web": ("", "web", None), "/x": ("", "/x", None),
             "x/": ("", "x/", None), "cron/a/b": ("cron", "a/b", None), "statefulsets/a": ("statefulsets", "a", "StatefulSet")}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kind, name = names.split_reference(F.col("t"))
    rows = df.select("t", kind.alias("k"), name.alias("n"), names.canonical_kind(kind).alias("c")).collect()
    assert {r.t: (r.k, r.n, r.c) for r in rows} == texts


def test_containers(spark):
    cases = [(["a"], "", None), (["istio-proxy", "a"], "a", 2), (["a", "b", "vector"], "a", 3), (["envoy", "fluentd"], "envoy", 2), ([], "", None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, names array<string>")
    rows = df.select("i", picks.choose_container(F.col("names")).alias("c"), picks.reported_containers(F.col("names")).alias("r")).orderBy("i").collect()
    assert [(r.c, r.r and len(r.r)) for r in rows] == [c[1:] for c in cases]


def test_pods_of_workloads(spark):
    """Against a nested loop over random labels and selectors, with a label most pods share."""
    rng = random.Random(3)
    keys, values = ["app", "tier", "zone"], ["x", "y", "z"]
    pods = [
        (f"ns{rng.randrange(2)}", f"p{i}", {"app": "hot"} if rng.random() < 0.5 else {k: rng.choice(values) for k in keys if rng.random() < 0.7},
         rng.choice(["Running", "Pending", "Failed", None]), i)
        for i in range(60)
    ]
    ops = ["In", "NotIn", "Exists", "DoesNotExist"]
    workloads = []
    for i in range(40):
        labels = {k: rng.choice([*values, "hot"]) for k in keys if rng.random() < 0.3} or None
        exprs = [(rng.choice(keys), rng.choice(ops), rng.sample(values, 2)) for _ in range(rng.randrange(3))] or None
        workloads.append((f"ns{rng.randrange(3)}", rng.choice(["Job", "Deployment"]), f"w{i}", labels, exprs, rng.choice([None, {}, {"app": "x"}])))

    def selects(w, pod):
        _, kind, _, labels, exprs, template = w
        if labels is None and exprs is None:
            if kind != "Job":
                return False
            return all(pod[2].get(k) == v for k, v in (template or {}).items())
        tests = {"In": lambda v, vs: v in vs, "NotIn": lambda v, vs: v not in vs,
                 "Exists": lambda v, _: v is not None, "DoesNotExist": lambda v, _: v is None}
        return all(pod[2].get(k) == v for k, v in (labels or {}).items()) and all(
            tests[op](pod[2].get(k), vs) for k, op, vs in exprs or []
        )

    pod_df = spark.createDataFrame(pods, "namespace string, name string, labels map<string,string>, phase string, pos long")
    work_df = spark.createDataFrame(
        workloads,
        "namespace string, kind string, name string, match_labels map<string,string>,"
        "match_expressions array<struct<key:string,op:string,values:array<string>>>, template_labels map<string,string>",
    )
    want = {w[2]: [p for p in pods if p[0] == w[0] and selects(w, p)] for w in workloads}
    pairs = sorted((r.name, r.pod) for r in picks.workload_pods(work_df, pod_df).collect())
    assert pairs == sorted((w, p[1]) for w, ps in want.items() for p in ps)
    picked = {r.name: (r.pod, r.pods) for r in picks.pick_pods(work_df, pod_df).collect()}
    assert picked == {
        w: (next((p[1] for p in ps if p[3] == "Running"), ps[0][1] if ps else None), len(ps)) for w, ps in want.items()
    }


def test_requested_lines(spark):
    """From references to lines: a workload's pod and chosen container, a named pod and container, and what is not found."""
    pods = [
        ("n", "p0", {"a": "1"}, None, 0, ["envoy", "main"]), ("n", "p1", {"a": "1"}, "Running", 1, ["envoy", "main"]),
        ("n", "solo", {}, "Running", 2, ["only"]),
    ]
    pods = spark.createDataFrame(pods, "namespace string, name string, labels map<string,string>, phase string, pos long, containers array<string>")
    workloads = spark.createDataFrame(
        [("n", "Deployment", "web", {"a": "1"}, None, None), ("n", "Deployment", "other", {"a": "2"}, None, None)],
        "namespace string, kind string, name string, match_labels map<string,string>,"
        "match_expressions array<struct<key:string,op:string,values:array<string>>>, template_labels map<string,string>",
    )
    asked = [
        (1, "n", "deploy/web", None), (2, "n", "p0", "envoy"), (3, "n", "solo", ""), (4, "n", "deploy/other", None),
        (5, "n", "deploy/none", None), (6, "n", "gone", None),
    ]
    requests = spark.createDataFrame(asked, "id int, namespace string, reference string, container string")
    found = {r.id: (r.pod, r.container, r.containers, r.problem) for r in logs.resolve_requests(requests, workloads, pods).collect()}
    assert found == {
        1: ("p1", "main", ["envoy", "main"], None), 2: ("p0", "envoy", None, None), 3: ("solo", "only", None, None),
        4: (None, None, None, "no pods found"), 5: (None, None, None, "workload not found"), 6: ("gone", None, None, "pod not found"),
    }
    lines = [("n", p, c, k, f"{p} {c} {k}") for p in ("p0", "p1", "solo") for c in ("envoy", "main", "only") for k in (1, 2)]
    lines = spark.createDataFrame(lines, "namespace string, pod string, container string, line_no long, value string")
    got = logs.requested_lines(requests, workloads, pods, lines).select("id", "source_id", "value").collect()
    assert sorted(map(tuple, got)) == sorted(
        (i, f"n/{p}/{c}", f"{p} {c} {k}") for i, p, c in ((1, "p1", "main"), (2, "p0", "envoy"), (3, "solo", "only")) for k in (1, 2)
    )


def test_members_that_differ_by_case(spark):
    df = spark.sql("SELECT named_struct('Aa', 1, 'aA', 'x', 'b', 2) AS s, array(named_struct('k', 1, 'K', 2)) AS l")
    row = df.select(path(df, "s.Aa").alias("a"), path(df, "s.aA").alias("b"), path(df, "s.AA").alias("c"), path(df, "l[*].K").alias("d")).first()
    assert tuple(row) == (1, "x", 1, [2])


def test_float_text(spark):
    cases = {0.0: "0", 1.5: "1.5", 1e-4: "0.0001", 1.234e-5: "1.234e-05", 123456.0: "123456", 1234567.0: "1.234567e+06",
             1e21: "1e+21", -2.5: "-2.5", 1.5e300: "1.5e+300", 100000.0: "100000", 0.1: "0.1"}
    df = spark.createDataFrame([(k,) for k in cases], "d double")
    assert {r.d: r.t for r in df.select("d", float_text(F.col("d")).alias("t")).collect()} == cases


def test_since(spark):
    as_of = dt.datetime(2026, 1, 1, 1, tzinfo=dt.timezone.utc)
    row = spark.range(1).select(
        P.since(F.lit("2026-01-01T00:30:00Z").cast("timestamp"), "30m", as_of).alias("a"),
        P.since(F.lit("2026-01-01T00:29:59Z").cast("timestamp"), "30m", as_of).alias("b"),
    ).first()
    assert tuple(row) == (True, False)
