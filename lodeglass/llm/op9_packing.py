"""Vector best-fit packing of documents into sequences: tokens are bounded, documents and attention cost on request.

Pieces of one length are alike, so the plan is made from their number per length, at most ``capacity`` figures however
large the corpus is. Bins with the same room are alike too, and are filled together. What the plan says is which
sequence and place the n-th piece of a length gets; each piece learns its number from prefix sums over partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeglass.llm import tokens
from lodeglass.llm.common import Query, others, stage, table

#: Tokens of a sequence.
CAPACITY = 4096
#: Weights of tokens, documents and attention cost in the choice of a bin.
WEIGHTS = (1.0, 0.01, 0.01)


def plan_bins(
    counts: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS, measure: str = "norm",
) -> np.ndarray:
    """Rows of length, first number, first bin, offset, number of pieces; counts are pieces per length.

    A row places pieces first, first + 1, .. of a length in bins of successive numbers, all at one offset. Lengths go
    longest first. Among the bins with room for a piece in every dimension, ``norm`` takes the one that is left with
    the smallest weighted residual, ``dot`` the one whose room has the smallest weighted product with the piece. A bin
    is filled with as many pieces of the length as it takes, since after one it fits the next best. The attention cost
    of a piece is its length squared.
    """
    caps = np.array([capacity, max_docs or capacity, max_cost or capacity**2], np.int64)
    room = np.empty((0, 3), np.int64)  # of groups of bins that are alike
    first, many = np.empty(0, np.int64), np.empty(0, np.int64)
    scale, w = caps.astype(float), np.array(weights)
    bins, rows = 0, []
    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        need = np.array([length, 1, length * length], np.int64)
        assert 0 < length and (need <= caps).all(), length
        while left:
            fits = np.flatnonzero((room >= need).all(1))
            if len(fits):
                rest = room[fits] / scale
                score = ((rest - need / scale) ** 2 * w).sum(1) if measure == "norm" else (rest * (need / scale) * w).sum(1)
                at = fits[np.argmin(score)]
                own, start, n = room[at], first[at], many[at]
            else:
                at, own, start, n = None, caps, bins, left
            each = int(min((own // need).min(), left))
            n = int(min(n, left // each))
            for k in range(each):
                rows.append((length, number, start, capacity - own[0] + k * length, n))
                number += n
            left -= n * each
            if at is None:
                bins += n
            else:
                first[at], many[at] = start + n, many[at] - n
            after = own - each * need
            if after[0] > 0 and after[1] > 0:
                room, first, many = np.vstack([room, after]), np.append(first, start), np.append(many, n)
            live = many > 0
            if not live.all():
                room, first, many = room[live], first[live], many[live]
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, **bounds) -> DataFrame:
    """``pieces`` (which have a ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``, which
    replace columns of those names.

    ``bounds`` go to :func:`plan_bins`. Sequences are numbered from 0 and filled from 0 without gaps. Equal rows are
    separate pieces. An empty table gives an empty one.
    """
    inner = pieces.select(others(pieces, "sequence_id", "offset"), F.col("length").cast("int").alias("length"))
    kind = inner.schema["row"].dataType.simpleString()
    placed_in = stage(inner.withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    among = Window.partitionBy("length", "task").orderBy("at")
    numbered = placed_in.select("row", "length", "task", (F.row_number().over(among) - 1).alias("number"))
    by_task = placed_in.groupBy("length", "task").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = stage(by_task.select("*", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = plan_bins(counts, capacity, **bounds)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    lengths, firsts, bins, offsets = (plan[:, k].copy() for k in range(4))
    step = int(max([0, *counts.values()])) + 1
    keys = lengths * step + firsts if (capacity + 1) * step < 2**62 else None
    assert keys is not None

    def placed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            at = np.searchsorted(keys, length * step + number, "right") - 1
            extra = (pa.array(bins[at] + number - firsts[at]), pa.array(offsets[at]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *extra], ["row", "sequence_id", "offset"])

    # a row for each length of each task: never broadcast, as it grows with the tasks
    known = numbered.join(base.drop("count").hint("merge"), ["length", "task"])
    known = known.select("row", "length", (F.col("base") + F.col("number")).alias("number"))
    out = known.mapInArrow(placed, f"row {kind}, sequence_id long, offset long")
    return out.select("row.*", "sequence_id", "offset")


def cut_documents(
    docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text",
    keep_ids: bool = False, wide: bool = True,
) -> DataFrame:
    """Pieces of at most ``capacity`` token ids: ``id``, piece, start, length, ids_crc32, and with ``keep_ids`` the ids
    as little-endian unsigned 32-bit integers, or 16-bit ones if not ``wide``.

    Every document has its ids and the ``end`` id, so null and empty texts are one piece of length 1. Only documents
    that are longer than ``capacity`` are cut. Other columns are left out.
    """
    keyed = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, at in tokens.encoded(rows, tokenizer, end):
            sizes = np.diff(at)
            parts = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            length = np.minimum(capacity, sizes[doc] - piece * capacity)
            low = at[doc] + piece * capacity
            own = [found[a : a + n] for a, n in zip(low.tolist(), length.tolist(), strict=True)]
            columns = {
                "id": batch.column("id").take(pa.array(doc)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(piece * capacity),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()),
            }
            ids = {"ids": pa.array([x.astype("<u4" if wide else "<u2").tobytes() for x in own], pa.binary())} if keep_ids else {}
            yield pa.RecordBatch.from_pydict(columns | ids)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return keyed.mapInArrow(cut, schema).withColumnRenamed("id", id)


def pack_documents(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    with ``keep_ids`` the piece's ids as little-endian unsigned 16-bit integers, which hold all ids of the tokenizer.

    Each document, a null or empty text too, has its ids and an end id; equal rows are packed each by itself, and a missing
    doc_id stays missing. A very long text is encoded whole and cut. Other columns are left out; no documents give no rows.
    """
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(cut_documents(docs, path, end=1, keep_ids=keep_ids, wide=False))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


QUERIES = {"op9_packing": Query(query)}
