"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back through memory maps.

A shard is three files: ``.tokens`` (all ids, 2 bytes each where the vocabulary allows, else 4), ``.offsets`` (64-bit,
where each document starts in the shard, and the shard's end) and ``.ids`` (64-bit document ids). ``index`` is a Parquet
table of shard, documents and tokens, and of how many come before it: prefix sums over the shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeglass.llm import tokens
from lodeglass.llm.common import Query, shared_folder, table

#: Bytes of text for each shard.
SHARD_BYTES = 32 << 20


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end: int, id: str = "doc_id", text: str = "text", wide: bool = False,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Write ``docs`` in ascending order of ``id`` (a whole number; missing ones first, and marked so in a file of their own).

    Equal ids are in order of a hash of their texts. Null and empty texts are one end id. ``wide``: 4 bytes for each
    id. Shards hold ranges of ids; ids that many rows have are split by text, so no shard must hold all rows of one. A shard's
    files get their names when they are whole, so a task that runs twice does no harm. An empty table has no shards.
    """
    keyed = docs.select(
        F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(-(2**63))).alias("id"),
        F.col(f"`{id}`").isNull().alias("missing"),
        F.col(f"`{text}`").alias("text"),
    )
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    order = ["id", ~F.col("missing"), F.xxhash64("text"), F.monotonically_increasing_id()]
    kind = "<u4" if wide else "<u2"

    def written(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path)
        shard, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        name = lambda what, mark="": f"{path}/{shard:06d}.{what}{mark}"
        starts, ids, missing = [np.zeros(1, np.int64)], [], []
        with store.open_output_stream(name("tokens", own)) as out:
            for batch, found, at in tokens.encoded(rows, tokenizer, end):
                out.write(found.astype(kind).tobytes())
                starts.append(starts[-1][-1] + at[1:])
                ids.append(batch.column("id").to_numpy(zero_copy_only=False))
                missing.append(batch.column("missing").to_numpy(zero_copy_only=False).astype(np.uint8))
        starts = np.concatenate(starts)
        files = {
            "offsets": starts.astype("<u8"),
            "ids": np.concatenate([*ids, np.empty(0, "<i8")]),
            "missing": np.concatenate([*missing, np.empty(0, np.uint8)]),
        }
        for what, values in files.items():
            with store.open_output_stream(name(what, own)) as out:
                out.write(values.tobytes())
        for what in ("tokens", *files):
            store.move(name(what, own), name(what))
        count = len(starts) - 1
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [count], "n_tokens": [int(starts[-1])]})

    ranged = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order[:3])
    made = ranged.mapInArrow(written, "shard long, n_docs long, n_tokens long").where("n_docs > 0")
    made.write.parquet(f"{folder}/made")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    index = docs.sparkSession.read.parquet(f"{folder}/made").select(
        "*",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in ("n_docs", "n_tokens")],
        F.lit(4 if wide else 2).alias("bytes"),
    )
    index.write.parquet(f"{folder}/index")


def read_tokens(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """One row per document of a written folder: id, start (tokens of all documents before it), n_tokens, ids_crc32
    (of its ids as little-endian unsigned 32-bit integers), and with ``keep_ids`` the ids as such bytes.

    A missing id is null again, equal ids and rows have a row each, null and empty texts their end id alone. A folder of an
    empty table has no rows. A document's ids are read at once, so the longest has to fit in a task.
    """
    index = spark.read.parquet(f"{folder}/index")
    columns = "id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        local = isinstance(store, fs.LocalFileSystem)

        def mapped(name: str, kind: str) -> np.ndarray:
            if local:
                return np.memmap(f"{path}/{name}", kind, "r")
            with store.open_input_file(f"{path}/{name}") as file:
                return np.frombuffer(file.read_buffer(), kind)

        for batch in rows:
            for shard in batch.to_pylist():
                name = f"{shard['shard']:06d}"
                found = mapped(f"{name}.tokens", f"<u{shard['bytes']}")
                starts, ids = mapped(f"{name}.offsets", "<u8").astype(np.int64), mapped(f"{name}.ids", "<i8")
                missing = mapped(f"{name}.missing", np.uint8).astype(bool)
                for low in range(0, len(ids), 1000):
                    high = min(low + 1000, len(ids))
                    own = [found[starts[i] : starts[i + 1]].astype("<u4") for i in range(low, high)]
                    out = {
                        "id": pa.array(ids[low:high], mask=missing[low:high]),
                        "start": starts[low:high] + shard["n_tokens_before"],
                        "n_tokens": np.diff(starts[low : high + 1]),
                        "ids_crc32": np.array([zlib.crc32(x) for x in own], np.int64),
                    }
                    if keep_ids:
                        out["ids"] = pa.array([x.tobytes() for x in own], pa.binary())
                    yield pa.RecordBatch.from_pydict(out)

    shards = index.count()
    return index.repartition(max(1, shards)).mapInArrow(read, columns)


def query(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    out = shared_folder(spark)
    write_tokens(table(spark, folder, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return read_tokens(spark, out).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {"op5_token_files": Query(query)}
