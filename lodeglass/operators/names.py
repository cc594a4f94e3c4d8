"""Names users write for resources: plural, singular or short, with or without a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of the workload kinds that own pods.
KIND_ALIASES = {
    "Deployment": ("deploy", "deployment", "deployments"),
    "StatefulSet": ("sts", "statefulset", "statefulsets"),
    "DaemonSet": ("ds", "daemonset", "daemonsets"),
    "ReplicaSet": ("rs", "replicaset", "replicasets"),
    "Job": ("job", "jobs"),
}

_ANY_GROUP = "*"


def resolve_resources(requests: DataFrame, resources: DataFrame, request_col: str = "request") -> DataFrame:
    """Add ``group, version, resource`` to requests by the first listed resource of that name; NULL when there is none.

    ``resources`` has ``pos, group, version, name, singular, short_names``. The first match per name is worked out
    before the join, so a request meets at most one row.
    """
    spellings = F.explode(
        F.array_distinct(
            F.transform(F.concat(F.array("name", "singular"), F.coalesce("short_names", F.array())), F.lower)
        )
    )
    named = resources.select("pos", "group", "version", "name", spellings.alias("_word"))
    scoped = named.where(F.col("_word") != "").withColumn(
        "_scope", F.explode(F.array(F.lower("group"), F.lit(_ANY_GROUP)))
    )
    first = scoped.groupBy("_word", "_scope").agg(
        F.min_by(F.struct("group", "version", F.col("name").alias("resource")), "pos").alias("_found")
    )
    lowered = F.lower(F.col(request_col))
    dotted = F.locate(".", lowered) > 1
    group = F.when(dotted, lowered.substr(F.locate(".", lowered) + 1, F.length(lowered))).otherwise("")
    asked = requests.withColumns(
        {
            "_word": F.when(dotted, F.substring_index(lowered, ".", 1)).otherwise(lowered),
            "_scope": F.when(group == "", _ANY_GROUP).otherwise(group),
        }
    )
    return asked.join(first, ["_word", "_scope"], "left").select(
        *requests.columns, "_found.group", "_found.version", "_found.resource"
    )


def split_reference(text: Column) -> tuple[Column, Column]:
    """``(type, name)`` of ``type/name``; a text without both parts is a plain pod name with an empty type."""
    parts = F.split(text, "/", 2)
    kind, name = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    both = F.coalesce((kind != "") & (name != ""), F.lit(False))
    return F.when(both, kind).otherwise(""), F.when(both, name).otherwise(text)


def canonical_kind(kind: Column) -> Column:
    """Workload kind of a spelling, ignoring case; NULL for kinds that own no pods."""
    spelled = [F.lit(x) for name, words in KIND_ALIASES.items() for word in words for x in (word, name)]
    return F.create_map(*spelled)[F.lower(kind)]
