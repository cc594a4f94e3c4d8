"""Exact substring removal with difference-cover anchors.

A window is ``window`` consecutive words. Every window whose words also begin in a document with a smaller id is
removed. Most windows occur once, so only anchors are compared first: shorter runs of words, hashed where their
position modulo the period lies in a difference cover. Any two positions have a shift below the period that puts both
in the cover, so equal windows at any two places share an anchor at the same distance from their start. Documents learn
which of their anchors occur elsewhere, and extend only those: the windows around them are hashed and compared.

Both comparisons run alike. A task groups its documents' hashes, settles repeats among its own documents, and sends one
entry per hash, packed by hash range. So a passage that a third of all documents hold costs one entry per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm import grams
from lodeglass.llm.common import Query, table

#: Words of a window.
WINDOW = 13
#: Period and difference cover: every difference modulo the period is one of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of text for each hash range, and ranges at least.
RANGE_BYTES, MIN_RANGES = 64 << 20, 64
#: Stands for a missing id: after all others.
_LAST = 2**63 - 1

_ENTRIES = "range int, local boolean, hashes binary, ids binary, counts binary"


def _entries(hashes: np.ndarray, ids: np.ndarray, n_ranges: int, width: int, salt: int, others: bool) -> Iterator[pa.RecordBatch]:
    """Packed rows of what a task found: one entry per hash for the smallest id, and local verdicts.

    ``others``: verdicts are for ids above the smallest; else for all ids of hashes that more than one id has.
    ``width``: bits that are kept of a hash; its range is told by other bits.
    """
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    own = grams.runs(hashes, ids)[:-1]
    hashes, ids = hashes[own], ids[own]
    at = grams.runs(hashes)
    first = at[:-1]
    size = np.diff(at)
    smallest = np.ones(len(hashes), bool)
    smallest[:] = False
    smallest[first] = True
    told = ~smallest if others else np.repeat(size > 1, size)
    kind = np.uint32 if width == 32 else np.uint64
    spread = (hashes >> np.uint64(32)) % np.uint64(n_ranges) if width == 32 else hashes % np.uint64(n_ranges)
    for local, chosen in ((False, smallest), (True, told)):
        if not chosen.any():
            continue
        place = np.full(chosen.sum(), salt % n_ranges, np.uint64) if local else spread[chosen]
        h, i = hashes[chosen], ids[chosen]
        order = np.lexsort((i, place))
        place, h, i = place[order], h[order].astype(kind), i[order]
        docs = grams.runs(place, i)
        counts = np.diff(docs).astype(np.uint32)
        rows = grams.runs(place)
        of_docs = np.searchsorted(docs[:-1], rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(place[rows[:-1]].astype(np.int32)),
                pa.array(np.full(len(rows) - 1, local)),
                grams.cut(h, rows),
                grams.cut(i[docs[:-1]], of_docs),
                grams.cut(counts, of_docs),
            ],
            ["range", "local", "hashes", "ids", "counts"],
        )


def _verdicts(width: int, others: bool):
    """Function of a hash range's entries: the hashes that each id is told, as rows of ``id`` and ``told``."""
    kind = np.uint32 if width == 32 else np.uint64

    def reduce(rows: pa.Table) -> pa.Table:
        local = rows.column("local").to_numpy(zero_copy_only=False)
        unpack = lambda part: (
            grams.joined(part.column("hashes"), kind),
            np.repeat(grams.joined(part.column("ids"), np.int64), grams.joined(part.column("counts"), np.uint32)),
        )
        hashes, ids = unpack(rows.filter(pa.array(~local)))
        order = np.lexsort((ids, hashes))
        hashes, ids = hashes[order], ids[order]
        at = grams.runs(hashes)
        low = np.repeat(ids[at[:-1]], np.diff(at))
        if others:
            chosen = ids > low
        else:
            high = np.repeat(ids[at[1:] - 1], np.diff(at)) if len(ids) else ids
            chosen = high > low
        settled = unpack(rows.filter(pa.array(local)))
        hashes, ids = np.append(hashes[chosen], settled[0]), np.append(ids[chosen], settled[1])
        order = np.argsort(ids, kind="stable")
        hashes, ids = hashes[order], ids[order]
        at = grams.runs(ids)
        return pa.table({"id": pa.array(ids[at[:-1]]), "told": grams.cut(hashes, at)})

    return reduce


def _exchange(entries: DataFrame, width: int, others: bool) -> DataFrame:
    told = entries.groupBy("range").applyInArrow(grams.tidy(_verdicts(width, others)), "id long, told binary")
    return told.groupBy("id").agg(F.collect_list("told").alias("told"))


def _anchors(words: grams.Words, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the anchors at cover positions, counted from the start of each text."""
    at, hashes = words.windows(window - period + 1)
    chosen = np.isin((at - words.first[words.doc[at]]) % period, cover)
    return at[chosen], hashes[chosen]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").to_numpy(zero_copy_only=False)


def _told(batch: pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of everything that the rows of a batch were told."""
    lists = [b"".join(x) if x else b"" for x in batch.column("told").to_pylist()]
    sizes = np.array([len(x) for x in lists], np.int64) // np.dtype(kind).itemsize
    return np.repeat(np.arange(len(lists)), sizes), np.frombuffer(b"".join(lists), kind)


def _among(rows: np.ndarray, hashes: np.ndarray, told: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which (row, hash) are among those told."""
    pair = lambda r, h: grams.mix(h.astype(np.uint64)) + grams.mix(r.astype(np.uint64) + np.uint64(1))
    return np.isin(pair(rows, hashes), pair(*told))


def _around(words: grams.Words, anchors: np.ndarray, window: int, period: int) -> np.ndarray:
    """Which windows' first words have an anchor of ``anchors`` less than a period behind."""
    n = len(words.hash)
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, np.maximum(anchors - period + 1, 0), 1)
    np.add.at(delta, anchors + 1, -1)
    return np.cumsum(delta[:-1]) > 0


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """``id``, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space) of every row.

    Words lie between white space and are compared unchanged. ``id`` is a whole number; a missing one is after all
    others. Ids that repeat, and equal rows, are no reason to remove anything from each other, and get the same
    verdicts from smaller ids. Null texts and texts below ``window`` words lose nothing. Other columns are left out.
    """
    assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and period <= window
    keyed = docs.select(
        F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_LAST)).alias("id"),
        F.col(f"`{id}`").isNull().alias("missing"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(MIN_RANGES, -(-size // RANGE_BYTES))

    def anchors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in grams.batches(rows):
            words = grams.Words(data, bounds)
            at, hashes = _anchors(words, window, period, cover)
            if len(at):
                salt = int(hashes[0] >> np.uint64(40))
                yield from _entries(hashes, _ids(batch)[words.doc[at]], n_ranges, 32, salt, others=False)

    def extended(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in grams.batches(rows):
            words = grams.Words(data, bounds)
            at, hashes = _anchors(words, window, period, cover)
            shared = at[_among(words.doc[at], hashes.astype(np.uint32), _told(batch, np.uint32))]
            at, hashes = words.windows(window)
            near = _around(words, shared, window, period)[at]
            at, hashes = at[near], hashes[near]
            if len(at):
                salt = int(hashes[0] >> np.uint64(40))
                yield from _entries(hashes, _ids(batch)[words.doc[at]], n_ranges, 64, salt, others=True)

    def removed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in grams.batches(rows):
            words = grams.Words(data, bounds)
            told = _told(batch, np.uint64)
            gone = np.zeros(len(words.hash) + 1, np.int32)
            if len(told[0]):
                at, hashes = words.windows(window)
                at = at[_among(words.doc[at], hashes, told)]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            yield _kept(batch, words, np.cumsum(gone[:-1]) == 0)

    first = _exchange(keyed.mapInArrow(anchors, _ENTRIES), 32, others=False)
    second = _exchange(keyed.join(first, "id").mapInArrow(extended, _ENTRIES), 64, others=True)
    out = keyed.join(second, "id", "left").mapInArrow(
        removed, "id long, missing boolean, n_words long, n_removed long, kept string"
    )
    return out.select(F.when(~F.col("missing"), F.col("id")).alias(id), "n_words", "n_removed", "kept")


def _kept(batch: pa.RecordBatch, words: grams.Words, keep: np.ndarray) -> pa.RecordBatch:
    """The words that stay, joined by one space: their bytes, and one byte after each but a text's last."""
    start, end, doc = words.start[keep], words.end[keep], words.doc[keep]
    marks = np.zeros(len(words.data) + 1, np.int8)
    marks[start] += 1
    marks[end] -= 1
    mask = np.cumsum(marks[:-1], dtype=np.int8) > 0
    between = end[:-1][doc[1:] == doc[:-1]]
    data = words.data.copy()
    data[between] = 32
    mask[between] = True
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    text = pa.Array.from_buffers(
        pa.string(), len(batch), [None, pa.py_buffer(sums[words.bounds].astype(np.int32)), pa.py_buffer(data[mask])]
    )
    left = np.bincount(doc, minlength=len(batch))
    return pa.RecordBatch.from_arrays(
        [batch.column("id"), batch.column("missing"), pa.array(words.count), pa.array(words.count - left), text],
        ["id", "missing", "n_words", "n_removed", "kept"],
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM docs),
g AS (
  SELECT r, doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) AS g
  FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS t(i) WHERE len(ws) >= {WINDOW}),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, i + k AS i FROM g JOIN f USING (g), range({WINDOW}) AS s(k) WHERE doc_id > least),
gone_of AS (SELECT r, list(i) AS gone FROM gone GROUP BY r),
left_over AS (
  SELECT r, doc_id, len(ws) AS n, coalesce(len(gone), 0) AS n_gone,
         CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM w LEFT JOIN gone_of USING (r))
SELECT doc_id, n::BIGINT AS n_words, n_gone::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM left_over
"""

QUERIES = {"op7_substrings": Query(query, SQL)}
