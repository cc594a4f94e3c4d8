"""Snapshots of cluster objects and events: one row per object, with ``kind, namespace, name`` as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.functions.predicates import Need, matches_fields, matches_labels


def read_snapshot(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Read a Parquet or JSON Lines snapshot. Give JSON a schema: inferring one reads the data twice."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(form).load(path)


def read_mixed(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of objects of any kind: ``kind, namespace, name`` and the whole object as VARIANT."""
    obj = F.try_parse_json("value")
    return spark.read.text(path).select(
        F.try_variant_get(obj, "$.kind", "string").alias("kind"),
        F.try_variant_get(obj, "$.metadata.namespace", "string").alias("namespace"),
        F.try_variant_get(obj, "$.metadata.name", "string").alias("name"),
        obj.alias("object"),
    )


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a snapshot that prunes by kind (folders) and by namespace and name (file and row-group statistics)."""
    order = ["kind", "namespace", "name"]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("kind").parquet(path)


def list_objects(
    objects: DataFrame,
    kind: str,
    namespace: str | None = None,
    all_namespaces: bool = False,
    labels: Sequence[Need] = (),
    labels_col: str = "labels",
) -> DataFrame:
    """All objects of a kind in one namespace or in all, optionally by label conditions."""
    found = _scoped(objects, namespace, all_namespaces).where(F.col("kind") == kind)
    return found.where(matches_labels(F.col(labels_col), labels)) if labels else found


def get_object(objects: DataFrame, kind: str, namespace: str, name: str) -> DataFrame:
    """The object of that kind, namespace and name as a one-row DataFrame."""
    for label, value in (("kind", kind), ("name", name), ("namespace", namespace)):
        if not value:
            raise ValueError(f"{label} is required")
    return objects.where((F.col("kind") == kind) & (F.col("namespace") == namespace) & (F.col("name") == name))


def list_events(
    events: DataFrame,
    namespace: str | None = None,
    kind: str | None = None,
    name: str | None = None,
    all_namespaces: bool = False,
    involved: str = "involvedObject",
) -> DataFrame:
    """Events, optionally of one involved kind and name."""
    target = F.col(involved)
    return _scoped(events, namespace, all_namespaces).where(
        matches_fields(kind=(target["kind"], kind), name=(target["name"], name))
    )


def _scoped(rows: DataFrame, namespace: str | None, all_namespaces: bool) -> DataFrame:
    if all_namespaces:
        return rows
    if not namespace:
        raise ValueError("namespace is required unless all namespaces are asked for")
    return rows.where(F.col("namespace") == namespace)
