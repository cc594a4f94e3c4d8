"""Vector code compression: product codes of integer vectors, trained and assigned by limb-split exact matrix products.

Components become whole numbers. A vector is cut into parts, and each part is named by the nearest entry of its
position's codebook. Nearest entries come from dot products: |a - b|^2 = |a|^2 - 2ab + |b|^2. The products are made by
float64 matrix multiplication, yet exactly: numbers are broken into limbs so short that no sum of products reaches 2^53,
one product is made per pair of limbs, and these are put together again as 64-bit integers.

A round is one pass over the written vectors. Tasks send sums and counts per entry, so what is shuffled and what reaches
the driver depends on the size of the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm.common import Query, stage, table

#: Parts of a vector, entries of a codebook (two hex digits name one), rounds of training, and units of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared with a codebook at once.
AT_ONCE = 4096
#: Keys among which a label's vectors are spread while they are joined with its error.
SALTS = 16
_LIMIT = 2**63


def _magnitude(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Whole numbers as float64 limbs, the lowest first: all but the last are below ``2**bits``, the last has the sign."""
    out, left = [], x
    while _magnitude(left) >= 1 << bits:
        out.append((left & ((1 << bits) - 1)).astype(np.float64))
        left = left >> bits
    return [*out, left.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of 64-bit integers, for results below 2^63: float64 products of limbs, added up as integers."""
    # d products of two limbs of so many bits stay below 2^53
    bits = (53 - max(a.shape[1], 1).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            out += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` for each vector, the lower one on ties, and the squared distance to it.

    Distances are 64-bit integers where they surely fit, else Python's.
    """
    most = max(_magnitude(vectors), _magnitude(book))
    if 4 * most * most * max(book.shape[1], 1) < _LIMIT // 2:
        own, other = ((x * x).sum(axis=1) for x in (vectors, book))
        away = exact_products(vectors, book)
        away *= -2
        away += own[:, None]
        away += other[None, :]
    else:
        vectors, book = vectors.astype(object), book.astype(object)
        away = np.stack([((vectors - entry) ** 2).sum(axis=1) for entry in book], axis=1)
    at = np.argmin(away, axis=1)
    return at, away[np.arange(len(at)), at]


def _blocks(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ``AT_ONCE`` rows with their vectors as a matrix, shorter vectors filled up with zeros."""
    for whole in rows:
        for low in range(0, len(whole), AT_ONCE):
            batch = whole.slice(low, AT_ONCE)
            column = batch.column("v")
            n = column.value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros((len(batch), width), np.int64)
            out[np.arange(width)[None, :] < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            yield batch, out


def _whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _kept(df: DataFrame, id: str, vector: str, label: str, scale: int) -> DataFrame:
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"), _whole(v, scale).alias("v")
    )


def _trained(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one round."""
    parts, entries, width = books.shape

    def sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for _, vectors in _blocks(rows, parts * width):
            # sums of a block in 64 bits where they fit
            exact = np.int64 if _magnitude(vectors) * max(len(vectors), 1) < _LIMIT else object
            for p in range(parts):
                own = vectors[:, p * width : (p + 1) * width]
                at, _ = nearest(own, books[p])
                order = np.argsort(at, kind="stable")
                used, begin = np.unique(at[order], return_index=True)
                if len(used) and width:
                    total[p, used] += np.add.reduceat(own[order].astype(exact), begin, axis=0)
                count[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(count)
        if not len(part):
            return
        at = np.repeat(np.arange(len(part)), width + 1)
        place = np.tile(np.arange(-1, width), len(part))
        # place -1 has the count
        values = np.concatenate([count[part, entry][:, None].astype(object), total[part, entry]], axis=1).ravel()
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(part[at].astype(np.int32)), "entry": pa.array(entry[at].astype(np.int32)),
                "place": pa.array(place.astype(np.int32)), "value": pa.array([*map(int, values)], pa.decimal128(38)),
            }
        )

    sent = kept.select("v").mapInArrow(sums, "part int, entry int, place int, value decimal(38,0)")
    added = sent.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
    # one row per component of the codebooks, however many vectors there are
    found = {(r["part"], r["entry"], r["place"]): int(r["value"]) for r in added.collect()}
    out = books.copy()
    for (p, e, place), value in found.items():
        if place >= 0:
            out[p, e, place] = value // found[p, e, -1]
    return out


def _assigned(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``id``, ``label``, ``code`` (one byte per part) and ``error`` (a decimal) of every vector."""
    parts, _, width = books.shape

    def codes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, vectors in _blocks(rows, parts * width):
            found = [nearest(vectors[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            code = np.stack([at for at, _ in found], axis=1).astype(np.uint8).reshape(-1)
            bounds = np.arange(len(batch) + 1, dtype=np.int32) * parts
            error = sum(away.astype(object) for _, away in found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("label"),
                    pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(bounds), pa.py_buffer(code)]),
                    pa.array([e if e < 10**38 else None for e in error], pa.decimal128(38)),
                ],
                ["id", "label", "code", "error"],
            )

    id, label = (kept.schema[c].dataType.simpleString() for c in ("id", "label"))
    return kept.mapInArrow(codes, f"id {id}, label {label}, code binary, error decimal(38,0)")


def compress(
    df: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """``id``, ``label``, ``code`` and ``error`` of every usable vector, and the codebooks by part, entry and place.

    Rows whose vector is null or holds null or non-finite components are dropped; all others stay, equal rows and equal
    or missing ids too. A component x becomes floor(scale * x), beyond 64 bits the last number that has them. Vectors are
    cut into ``parts`` equal parts; those that are shorter than the longest, or whose length ``parts`` does not divide,
    are taken as filled up with zeros. Codebooks start as the parts of the first ``entries`` (256 at most) vectors by id,
    missing ids last, then by vector; fewer vectors make smaller codebooks. In every round each part is given to its
    nearest entry, the lower one on ties, and entries in use become the floored means of their parts. ``code`` has one
    byte per part, ``error`` the sum of squared distances. Without usable vectors there are no rows and no entries.
    Other columns are left out, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte per part: 1 to 256 entries")
    kept = stage(_kept(df, id, vector, label, scale))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.zeros((parts, len(first), width), np.int64)
    for e, row in enumerate(first):
        filled = np.zeros(parts * width, np.int64)
        filled[: len(row["v"])] = row["v"]
        books[:, e] = filled.reshape(parts, width)
    if len(first):
        for _ in range(rounds):
            books = _trained(kept, books)
    out = _assigned(kept, books)
    return out.select(F.col("id").alias(id), F.col("label").alias(label), "code", "error"), books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels, missing ones together.

    Errors are added up before they are exchanged. A label's rows are spread over ``SALTS`` keys for the join, so a label
    that a third of all rows share does not go to one task; while the sums are few, Spark broadcasts them by their size.
    """
    coded = stage(coded)
    sums = stage(coded.groupBy(F.col(f"`{label}`").alias("_label")).agg(F.sum("error").alias("label_error")))
    spread = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt_"))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)).cast("int"))
    same = F.col(f"`{label}`").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_salt_"))
    return salted.join(spread, same).drop("_label", "_salt", "_salt_")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Sums beyond 64 bits are null."""
    coded, books = compress(table(spark, folder, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    long = lambda name: F.expr(f"try_cast({name} AS bigint)").alias(name)
    return with_label_error(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), long("error"), long("label_error"), F.lit(digest).alias("codebooks_sha256")
    )


def _sql() -> str:
    """Every round as a table of its own: distances from a join by part and place, the least one by entry."""
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(f"""
away{k} AS (
  SELECT r, v.part, entry, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d
  FROM placed v JOIN book{k} b ON v.part = b.part AND v.place = b.place GROUP BY r, v.part, entry),
near{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM away{k} GROUP BY r, part)""")
        if k < ROUNDS:
            rounds.append(f"""
mean{k} AS (
  SELECT v.part, n.entry, v.place, sum(v.x)::HUGEINT AS s, count(*) AS c
  FROM placed v JOIN near{k} n ON v.r = n.r AND v.part = n.part GROUP BY v.part, n.entry, v.place),
book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce((s - ((s % c) + c) % c) // c, b.x)::BIGINT AS x
  FROM book{k} b LEFT JOIN mean{k} USING (part, entry, place))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
placed AS MATERIALIZED (
  SELECT r, (i * {PARTS}) // n AS part, i % (n // {PARTS}) AS place, x FROM (
    SELECT r, len(embedding) AS n, unnest(range(len(embedding))) AS i, CAST(floor({SCALE} * unnest(embedding)::DOUBLE) AS BIGINT) AS x
    FROM kept)),
book0 AS MATERIALIZED (SELECT part, r AS entry, place, x FROM placed WHERE r < {ENTRIES}),{",".join(rounds)},
final AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book{ROUNDS}),
named AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN final USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM kept JOIN final USING (r) JOIN named ON kept.label IS NOT DISTINCT FROM named.label CROSS JOIN digest
"""


QUERIES = {"op13_codes": Query(query, _sql())}
