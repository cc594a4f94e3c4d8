"""Which pods belong to a workload, which of them to read, and which of a pod's containers.

Workloads: ``namespace, kind, name, match_labels map, match_expressions array<struct<key,op,values>>,
template_labels map`` with ``op`` one of ``In NotIn Exists DoesNotExist``.
Pods: ``namespace, name, labels map, phase, pos`` where ``pos`` is the listing order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.operators.names import canonical_kind, split_reference

# Container names that proxies, log shippers and the like usually have.
SIDECARS = (
    "istio-proxy",
    "envoy",
    "envoy-sidecar",
    "linkerd-proxy",
    "jaeger-agent",
    "oauth-proxy",
    "vault-agent",
    "vault-agent-init",
    "filebeat",
    "fluentd",
    "fluentbit",
    "fluent-bit",
    "promtail",
    "vector",
    "log-collector",
    "kube-rbac-proxy",
)
RUNNING = "Running"

_WORKLOAD = ["namespace", "kind", "name"]

# Label sets of a namespace are dealt over so many keys for workloads that have no positive condition.
SPREAD = 64


def _equal_needs(labels: Column) -> Column:
    return F.transform(
        F.map_entries(labels),
        lambda e: F.struct(e["key"].alias("key"), F.lit("In").alias("op"), F.array(e["value"]).alias("values")),
    )


def with_needs(workloads: DataFrame) -> DataFrame:
    """Add ``needs``, the conditions a pod's labels have to meet, and ``takes_all``.

    A Job without a selector uses its template's labels; if it has none either, every pod of the namespace is its own.
    Any other empty selector finds nothing.
    """
    no_selector = F.col("match_labels").isNull() & F.col("match_expressions").isNull()
    from_template = no_selector & (F.col("kind") == "Job")
    none = F.array().cast("array<struct<key:string,op:string,values:array<string>>>")
    selector = F.concat(
        F.coalesce(_equal_needs(F.col("match_labels")), none),
        F.coalesce(
            F.transform(
                "match_expressions",
                lambda e: F.struct(e["key"].alias("key"), e["op"].alias("op"), e["values"].alias("values")),
            ),
            none,
        ),
    )
    template = F.coalesce(_equal_needs(F.col("template_labels")), none)
    needs = F.when(from_template, template).otherwise(selector)
    return workloads.withColumn("needs", needs).withColumn(
        "takes_all", from_template & (F.size("needs") == 0)
    )


def _meets_all(needs: Column, labels: Column) -> Column:
    def met(one: Column) -> Column:
        value = labels[one["key"]]
        listed = F.coalesce(F.array_contains(one["values"], value), F.lit(False))
        return (
            F.when(one["op"] == "In", listed)
            .when(one["op"] == "NotIn", ~listed)
            .when(one["op"] == "Exists", value.isNotNull())
            .otherwise(value.isNull())
        )

    return F.forall(needs, met)


def _label_sets(pods: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per namespace and set of labels: pods of one workload mostly share theirs."""
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    keyed = pods.withColumn("label_set", F.array_sort(F.map_entries(labels)))
    return keyed.groupBy("namespace", "label_set").agg(F.count(F.lit(1)).alias("_pods"), *aggregates)


def _free_word(number: Column) -> Column:
    """A word that no label is: keys and values hold no control characters."""
    return F.concat(F.lit("\x01"), number.cast("string"))


def _match_sets(workloads: DataFrame, sets: DataFrame) -> DataFrame:
    """``namespace, kind, name, label_set`` for every label set that meets a workload's conditions.

    The join key of a workload is the rarest of its positive conditions in the namespace, so a label that most pods
    share is used only when a workload has nothing rarer; the other conditions are checked on the candidates. A workload
    without positive conditions meets all label sets of its namespace, a part of them under each of ``SPREAD`` keys.
    """
    words = F.flatten(
        F.array(
            F.transform("label_set", lambda e: F.concat(e["key"], F.lit("="), e["value"])),
            F.transform("label_set", lambda e: e["key"]),
            F.array(_free_word(F.pmod(F.xxhash64("label_set"), F.lit(SPREAD)))),
        )
    )
    by_word = sets.withColumn("_word", F.explode(F.array_distinct(words)))
    frequency = by_word.groupBy("namespace", "_word").agg(F.count(F.lit(1)).alias("_sets"))

    needed = with_needs(workloads).where((F.size("needs") > 0) | F.col("takes_all"))

    def need_words(one: Column) -> Column:
        return F.when(
            one["op"] == "In",
            F.array_distinct(F.transform(one["values"], lambda v: F.concat(one["key"], F.lit("="), v))),
        ).when(one["op"] == "Exists", F.array(one["key"]))

    options = F.filter(F.transform("needs", need_words), lambda w: w.isNotNull())
    every = F.array(*[_free_word(F.lit(k)) for k in range(SPREAD)])
    options = F.when(F.size(options) > 0, options).otherwise(F.array(every))
    ranked = (
        needed.select(*_WORKLOAD, F.posexplode(options).alias("_option", "_words"))
        .withColumn("_word", F.explode_outer("_words"))
        .join(frequency, ["namespace", "_word"], "left")
        .groupBy(*_WORKLOAD, "_option")
        .agg(F.sum(F.coalesce("_sets", F.lit(0))).alias("_cost"), F.any_value("_words").alias("_words"))
        .groupBy(*_WORKLOAD)
        .agg(F.min_by("_words", F.struct("_cost", "_option")).alias("_words"))
    )
    anchored = (
        needed.select(*_WORKLOAD, "needs")
        .join(ranked, _WORKLOAD)
        .withColumn("_word", F.explode("_words"))
        .drop("_words")
    )
    candidates = anchored.join(by_word, ["namespace", "_word"])
    labels = F.map_from_entries("label_set")
    return candidates.where(_meets_all(F.col("needs"), labels)).drop("needs", "_word")


def workload_pods(workloads: DataFrame, pods: DataFrame) -> DataFrame:
    """``namespace, kind, name, pod`` for every pod that a workload selects."""
    matches = _match_sets(workloads, _label_sets(pods)).drop("_pods")
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    keyed = pods.select(
        "namespace", F.array_sort(F.map_entries(labels)).alias("label_set"), F.col("name").alias("pod")
    )
    return matches.join(keyed, ["namespace", "label_set"]).select(*_WORKLOAD, "pod")


def pick_pods(workloads: DataFrame, pods: DataFrame) -> DataFrame:
    """``namespace, kind, name, pod, phase, pods`` per workload: its first running pod, else its first pod, else NULL."""
    rank = F.struct((~F.col("phase").eqNullSafe(RUNNING)).alias("late"), "pos")
    best = F.min_by(F.struct(F.col("name").alias("pod"), "phase"), rank).alias("_best")
    sets = _label_sets(pods, best, F.min(rank).alias("_rank"))
    chosen = (
        _match_sets(workloads, sets)
        .groupBy(*_WORKLOAD)
        .agg(F.min_by("_best", "_rank").alias("_best"), F.sum("_pods").alias("pods"))
    )
    return workloads.select(*_WORKLOAD).join(chosen, _WORKLOAD, "left").select(
        *_WORKLOAD, "_best.pod", "_best.phase", F.coalesce("pods", F.lit(0)).alias("pods")
    )


def resolve_pods(requests: DataFrame, workloads: DataFrame, pods: DataFrame) -> DataFrame:
    """Add ``pod`` and ``problem`` to requests ``namespace, reference``.

    A reference is a pod name, taken as it is, or ``type/name`` of a workload.
    """
    kind, name = split_reference(F.col("reference"))
    asked = requests.withColumns({"_type": kind, "_name": name}).withColumn("_kind", canonical_kind(F.col("_type")))
    wanted = asked.select("namespace", F.col("_kind").alias("kind"), F.col("_name").alias("name")).distinct()
    picked = pick_pods(workloads.join(wanted, _WORKLOAD, "left_semi"), pods).select(
        "namespace", F.col("kind").alias("_kind"), F.col("name").alias("_name"),
        F.col("pod").alias("_pod"), F.lit(True).alias("_known"),
    )
    joined = asked.join(picked, ["namespace", "_kind", "_name"], "left")
    plain = F.col("_type") == ""
    problem = (
        F.when(plain, F.lit(None))
        .when(F.col("_kind").isNull(), "unsupported resource type")
        .when(F.col("_known").isNull(), "workload not found")
        .when(F.col("_pod").isNull(), "no pods found")
    )
    return joined.select(
        *requests.columns,
        F.when(plain, F.col("_name")).otherwise(F.col("_pod")).alias("pod"),
        problem.alias("problem"),
    )


def choose_container(names: Column) -> Column:
    """Container to read: the only one (unnamed), else the first that is no sidecar, else the first."""
    own = F.filter(names, lambda n: ~n.isin(*SIDECARS))
    first = F.coalesce(F.get(own, F.lit(0)), F.get(names, F.lit(0)))
    return F.when(F.size(names) > 1, first).otherwise("")


def reported_containers(names: Column) -> Column:
    """All names where a choice was made, else NULL."""
    return F.when(F.size(names) > 1, names)
