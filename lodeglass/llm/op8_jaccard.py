"""N-gram Jaccard join: a size-aware heavy-light join, exact, with components of linked documents.

Documents are sets of word shingles. Two sets of Jaccard similarity t share at least t of the larger one. So

* a set with too many shingles that no other text has is linked with none, and most documents end there;
* small (light) sets name all their subsets of the least shared size: two linked light sets name one in common;
* large (heavy) sets, and light ones large enough to be linked with a heavy one, are listed under the first tokens of a
  global order, as many as a linked set cannot all miss. Tokens that are frequent by a sketch of bounded size come last in
  that order, so what many texts share, such as a template, makes no lists unless there is nothing else.

The boundary between light and heavy is where the costs counted over the sizes are least. Sets in one list are
candidates. Copies of a text are one member. In each list every member is first compared with one centre; linked sets
form components, and only lists whose members are still in several components are compared further, across those: by
tiles of members, on bits that tell texts apart, without a row per pair. Each candidate is verified on the texts. So a
group of n near copies costs about n comparisons, not n squared, and no two linked texts end up in different components.
"""

from __future__ import annotations

import itertools
import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm import grams
from lodeglass.llm.common import Query, others, stage, table
from lodeglass.llm.components import components

#: Words of a shingle, and least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Sets above this size are heavy whatever the costs; their subsets could not be counted out.
MAX_LIGHT = 14
#: Cost of scanning one list entry, with the verification it may bring, in subsets named.
SCAN = 4
#: Bits that tell texts apart before they are compared.
BITS = 1024
#: Bytes of texts that are handled at once.
AT_ONCE = 2 << 20
#: Counters of the sketch of frequent tokens, and members of a list that are compared at once.
COUNTERS, TILE = 1 << 20, 4096
#: Entries of one token's list that are handled at once; more are dealt over several groups.
LIST_ROWS = 1 << 20
#: Stands for a missing id: after all others.
_LAST = 2**63 - 1
#: Bytes of text for each hash range, and ranges at least.
RANGE_BYTES, MIN_RANGES = 16 << 20, 32


def _needed(n: np.ndarray | int, percent: int):
    """The least overlap of a set of ``n`` with any set that it is linked with."""
    return -(-n * percent // 100)


def _sets(data: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle, by text and hash; fewer words are one shingle."""
    found = grams.Words(data, bounds, folded=True)
    at, hashes = found.windows(shingle)
    doc = found.doc[at]
    for size in range(1, shingle):
        if (found.count == size).any():
            at, own = found.windows(size)
            chosen = found.count[found.doc[at]] == size
            doc, hashes = np.append(doc, found.doc[at][chosen]), np.append(hashes, own[chosen])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    own = grams.runs(doc, hashes)[:-1]
    return doc[own], hashes[own]


def _subsets(hashes: list[int], percent: int) -> Iterator[int]:
    """Hashes of all subsets that a linked set could share whole: sums, so order does not matter, told apart by size."""
    whole, n = sum(hashes), len(hashes)
    for left_out in range(n - _needed(n, percent) + 1):
        for gone in itertools.combinations(hashes, left_out):
            yield (whole - sum(gone) + (n - left_out) * 0x9E3779B97F4A7C15) % 2**64


def light_boundary(sizes: dict[int, int], percent: int = PERCENT, scan: int = SCAN, most: int = MAX_LIGHT) -> int:
    """The size up to which sets are light, given the number of sets of each size: the cheapest, at most ``most``."""

    def cost(bound: int) -> int:
        total = 0
        for n, count in sizes.items():
            if n <= bound:
                total += count * sum(math.comb(n, d) for d in range(n - _needed(n, percent) + 1))
            if n >= _needed(bound + 1, percent):
                total += count * scan * (n - _needed(n, percent) + 1)
        return total

    return min(range(most + 1), key=cost)


def _packed(range_of: np.ndarray, owner: np.ndarray, tokens: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows of a hash range: its tokens by owner, how many each owner has, and the owners' ``columns``."""
    order = np.lexsort((owner, range_of))
    range_of, owner, tokens = range_of[order], owner[order], tokens[order].astype(np.uint32)
    docs, ranges = grams.runs(range_of, owner), grams.runs(range_of)
    of_docs = np.searchsorted(docs[:-1], ranges)
    who = owner[docs[:-1]]
    parts = {
        "range": pa.array(range_of[ranges[:-1]].astype(np.int32)),
        "tokens": grams.cut(tokens, ranges),
        "counts": grams.cut(np.diff(docs).astype(np.uint32), of_docs),
    }
    return pa.RecordBatch.from_pydict(parts | {k: grams.cut(v[who], of_docs) for k, v in columns.items()})


def _range_of(tokens: np.ndarray, n_ranges: int) -> np.ndarray:
    return (tokens >> np.uint64(32)) % np.uint64(n_ranges)


def _measured(keyed: DataFrame, shingle: int, n_ranges: int) -> DataFrame:
    """``id``, ``key`` and ``size`` of every row, and rows of ``key`` and ``alone``, the shingles that no other text has,
    for each hash range.

    A task sends a shingle that several of its texts have once, for no text; so a shingle that a third of all documents
    have costs one entry per task. Shingles are told apart by 32 bits and their range; two that are not only seem less
    alone.
    """

    def shingles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in grams.batches(rows, size=AT_ONCE):
            doc, hashes = _sets(data, bounds, shingle)
            id, key = (batch.column(c).fill_null(_LAST).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            sizes = np.bincount(doc, minlength=len(batch))
            copies = np.ones(len(batch), bool)
            copies[np.unique(key, return_index=True)[1]] = False
            owner, tokens = doc[~copies[doc]], hashes[~copies[doc]]
            order = np.argsort(tokens, kind="stable")
            owner, tokens = owner[order], tokens[order]
            at = grams.runs(tokens)
            first, shared = at[:-1], np.diff(at) > 1
            owner, tokens = np.where(shared, len(batch), owner[first]), tokens[first]
            if len(tokens):
                out = _packed(_range_of(tokens, n_ranges), owner, tokens, keys=np.append(key, 0), owned=np.append(np.ones(len(batch), np.int8), np.int8(0)))
                yield pa.RecordBatch.from_pydict(
                    dict(zip(out.schema.names, out.columns, strict=True)) | {k: pa.nulls(len(out), pa.binary()) for k in ("ids", "sizes")}
                )
            whole = np.array([0, len(batch)])
            yield pa.RecordBatch.from_pydict(
                {
                    "range": pa.array([int(key[0]) % n_ranges], pa.int32()),
                    **{k: pa.nulls(1, pa.binary()) for k in ("tokens", "counts")},
                    "keys": grams.cut(key, whole),
                    "owned": pa.nulls(1, pa.binary()),
                    "ids": grams.cut(id, whole),
                    "sizes": grams.cut(sizes, whole),
                }
            )

    def alone(rows: pa.Table) -> pa.Table:
        done = rows.filter(rows.column("tokens").is_null())
        rows = rows.filter(rows.column("tokens").is_valid())
        counts = grams.joined(rows.column("counts"), np.uint32)
        spread = lambda name, kind: np.repeat(grams.joined(rows.column(name), kind), counts)
        tokens, keys, owned = grams.joined(rows.column("tokens"), np.uint32), spread("keys", np.int64), spread("owned", np.int8)
        order = np.lexsort((keys, tokens))
        tokens, keys, owned = tokens[order], keys[order], owned[order]
        at = grams.runs(tokens)
        if len(tokens):
            first, last = at[:-1], at[1:] - 1
            single = (keys[first] == keys[last]) & (np.minimum.reduceat(owned, first) == 1)
            keys, counts = np.unique(keys[first][single], return_counts=True)
        else:
            counts = np.empty(0, np.int64)
        ids, own = grams.joined(done.column("ids"), np.int64), grams.joined(done.column("keys"), np.int64)
        sizes = grams.joined(done.column("sizes"), np.int64)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table(
            {
                "id": pa.concat_arrays([pa.array(ids), none(len(keys))]),
                "key": pa.array(np.append(own, keys)),
                "size": pa.concat_arrays([pa.array(sizes), none(len(keys))]),
                "alone": pa.concat_arrays([none(len(own)), pa.array(counts)]),
            }
        )

    schema = "range int, tokens binary, counts binary, keys binary, owned binary, ids binary, sizes binary"
    packed = keyed.mapInArrow(shingles, schema)
    return packed.groupBy("range").applyInArrow(grams.tidy(alone), "id long, key long, size long, alone long")


def frequencies(texts: DataFrame, shingle: int, counters: int) -> np.ndarray:
    """How many of ``texts`` have a token, by the counter that its hash falls on. A sketch: it only says what stands out. Of
    its ``counters`` numbers a task sends those that are several times its mean."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for _, data, bounds in grams.batches(rows, size=AT_ONCE):
            _, hashes = _sets(data, bounds, shingle)
            at, n = np.unique((hashes % np.uint64(counters)).astype(np.int64), return_counts=True)
            total[at] += n
        at = np.flatnonzero(total > max(4, 4 * total.mean()))
        yield pa.RecordBatch.from_pydict({"counter": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    sent = texts.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    found = sent.toArrow()
    out = np.zeros(counters, np.int64)
    out[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return out


def _listed(keyed: DataFrame, shingle: int, percent: int, light: int, n_ranges: int, often: np.ndarray) -> DataFrame:
    """Members of every list that holds at least two texts: list, members and centre.

    Lists with the same members are one list for each hash range, told by the members' hash, with the number of tokens
    that have it. A list that is too long for one group, by ``often``, is dealt over several by its members' keys; it is
    told by its token, and each part has a centre of its own.
    """
    heavy_from = _needed(light + 1, percent)
    counters, rank = np.uint64(len(often)), np.log2(often + 1).astype(np.uint8)
    split_in = {int(c): -(-int(often[c]) // LIST_ROWS) for c in np.flatnonzero(often > LIST_ROWS)}

    def parts_of(tokens: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The number of the part of its list that an entry is in."""
        out = np.zeros(len(tokens), np.uint64)
        counter = (tokens % counters).astype(np.int64)
        for c, n in split_in.items():
            own = counter == c
            out[own] = (keys[own] % n).astype(np.uint64)
        return out

    def lists(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in grams.batches(rows, size=AT_ONCE):
            doc, hashes = _sets(data, bounds, shingle)
            hashes = hashes[np.lexsort((hashes, rank[hashes % counters], doc))]
            sizes = np.bincount(doc, minlength=len(batch))
            begin = np.cumsum(sizes) - sizes
            place = np.arange(len(doc)) - begin[doc]
            prefix = sizes - _needed(sizes, percent) + 1
            chosen = (place < prefix[doc]) & (sizes[doc] >= heavy_from)
            tokens, owner = hashes[chosen], doc[chosen]
            named = [
                (h, d)
                for d in np.flatnonzero((sizes > 0) & (sizes <= light)).tolist()
                for h in _subsets(hashes[begin[d] : begin[d] + sizes[d]].tolist(), percent)
            ]
            if named:
                tokens = np.append(tokens, np.array([h for h, _ in named], np.uint64))
                owner = np.append(owner, np.array([d for _, d in named], np.int64))
            if not len(tokens):
                continue
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            range_of = (_range_of(tokens, n_ranges) + parts_of(tokens, column("key")[owner])) % np.uint64(n_ranges)
            yield _packed(
                range_of, owner, tokens, keys=column("key"), ids=column("id"), sizes=sizes.astype(np.uint32), shared=column("shared")
            )

    def members(rows: pa.Table) -> pa.Table:
        counts = grams.joined(rows.column("counts"), np.uint32)
        spread = lambda name, kind: np.repeat(grams.joined(rows.column(name), kind), counts)
        tokens, keys = grams.joined(rows.column("tokens"), np.uint32), spread("keys", np.int64)
        ids, sizes, shared = spread("ids", np.int64), spread("sizes", np.uint32).astype(np.int64), spread("shared", np.int64)
        order = np.lexsort((keys, tokens))
        own = order[grams.runs(tokens[order], keys[order])[:-1]]
        tokens, keys, ids, sizes, shared = tokens[own], keys[own], ids[own], sizes[own], shared[own]
        at = grams.runs(tokens)
        count = np.diff(at)
        # the counters are a power of two, so a token's low bits tell its own
        token = tokens[at[:-1]].astype(np.uint64)
        dealt = np.isin(token % counters, np.array([*split_in], np.uint64))
        several = (count > 1) | dealt
        spread_out = np.repeat(several, count)
        keys, ids, sizes, shared = (x[spread_out] for x in (keys, ids, sizes, shared))
        count, token, dealt = count[several], token[several], dealt[several]
        begin = np.cumsum(count) - count
        names = np.add.reduceat(grams.mix(keys.view(np.uint64)), begin) if len(begin) else np.empty(0, np.uint64)
        names = np.where(dealt, grams.mix(token), names)
        _, first, times = np.unique(names, return_index=True, return_counts=True)
        fresh = np.zeros(len(count), bool)
        fresh[first] = True
        spread_out = np.repeat(fresh, count)
        keys, ids, sizes, shared = (x[spread_out] for x in (keys, ids, sizes, shared))
        names, count, dealt, tokens = names[fresh], count[fresh], dealt[fresh], times[np.argsort(first, kind="stable")]
        lists = np.repeat(np.arange(len(count)), count)
        begin = np.cumsum(count) - count
        centre = np.lexsort((keys, ids, lists))[begin]
        return pa.table(
            {
                "list": pa.array(names.view(np.int64)[lists]),
                "members": pa.array(count[lists]),
                "dealt": pa.array(dealt[lists]),
                "tokens": pa.array(tokens[lists]),
                "key": pa.array(keys),
                "size": pa.array(sizes),
                "shared": pa.array(shared),
                "centre": pa.array(keys[centre][lists]),
                "centre_size": pa.array(sizes[centre][lists]),
                "centre_shared": pa.array(shared[centre][lists]),
            }
        )

    packed = keyed.mapInArrow(lists, "range int, tokens binary, counts binary, keys binary, ids binary, sizes binary, shared binary")
    schema = "list long, members long, dealt boolean, tokens long, key long, size long, shared long, centre long, centre_size long, centre_shared long"
    return packed.groupBy("range").applyInArrow(grams.tidy(members), schema)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (distinct ``a``, ``b``) whose texts are linked; ``texts`` has ``key`` and ``text``."""

    def linked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch, data, bounds in grams.batches(iter([whole]), "text_a", AT_ONCE):
                sets = [_sets(data, bounds, shingle)]
                other = batch.column("text_b").cast(pa.large_binary())
                bounds = np.append(0, np.cumsum([len(x) for x in (y.as_py() for y in other)]))
                data = np.frombuffer(b"".join(other.to_pylist()), np.uint8)
                sets.append(_sets(data, bounds, shingle))
                sizes = [np.bincount(doc, minlength=len(batch)) for doc, _ in sets]
                doc, hashes = (np.concatenate(x) for x in zip(*sets, strict=True))
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                both = (doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])
                shared = np.bincount(doc[1:][both], minlength=len(batch))
                close = (100 * shared >= percent * (sizes[0] + sizes[1] - shared)) & (shared > 0)
                yield batch.select(["a", "b"]).filter(pa.array(close))

    a, b = (texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(b, "b").join(a, "a").mapInArrow(linked, "a long, b long")


def _parities(texts: DataFrame, shingle: int) -> DataFrame:
    """``key`` and ``BITS`` bits of each text: whether it has an odd number of the shingles that fall on a bit.

    Where two texts' bits differ there is a shingle that only one of them has, so no more bits differ than shingles.
    """

    def parities(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in grams.batches(rows, size=AT_ONCE):
            doc, hashes = _sets(data, bounds, shingle)
            places = np.sort(doc * BITS + (hashes % np.uint64(BITS)).astype(np.int64))
            at = grams.runs(places)
            bits = np.zeros(len(batch) * BITS, bool)
            bits[places[at[:-1][np.diff(at) % 2 == 1]]] = True
            packed = grams.cut(np.packbits(bits), np.arange(len(batch) + 1) * (BITS // 8))
            yield pa.RecordBatch.from_arrays([batch.column("key"), packed], ["key", "bits"])

    return texts.select("key", "text").mapInArrow(parities, "key long, bits binary")


def _compared(percent: int):
    """The pairs of a tile of a list that may be linked: of different components, of sizes that allow it, with enough
    shingles that are not theirs alone, and with few enough bits apart. Rows have ``own``, the tile that a member is in."""

    def compare(rows: pa.Table) -> pa.Table:
        column = lambda name: rows.column(name).to_numpy()
        own, key, root, size, shared = (column(c) for c in ("own", "key", "root", "size", "shared"))
        bits = grams.joined(rows.column("bits"), np.uint64).reshape(len(own), -1)
        tokens = rows.column("tokens")[0].as_py() if len(own) else 0
        left, right = (np.flatnonzero(own == side) for side in (own.min(), own.max()))
        # most members may be in one component already: those are compared with the others alone
        names, times = np.unique(root, return_counts=True)
        main = root == names[np.argmax(times)]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        within = (own == own[0]).all()
        sides = [(left[~main[left]], right)] + ([] if within else [(left[main[left]], right[~main[right]])])
        for one, other in sides:
            step = max(1, (4 << 20) // max(1, len(other) * bits.shape[1]))
            for low in range(0, len(one), step):
                x, y = one[low : low + step, None], other[None, :]
                need = -(-(size[x] + size[y]) * percent // (100 + percent))
                may = (root[x] != root[y]) & (np.minimum(shared[x], shared[y]) >= need)
                may &= np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * percent
                if within:
                    may &= (key[x] < key[y]) | main[y]
                i, j = np.nonzero(may)
                i, j = one[low + i], other[j]
                apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                close = apart * (100 + percent) <= (size[i] + size[j]) * (100 - percent)
                found.append((i[close], j[close]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        swap = key[i] > key[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pa.table(
            {"a": key[i], "b": key[j], "x": size[i], "y": size[j], "tokens": np.full(len(i), tokens, np.int64)}
        )

    return compare


def _linkable(x: str, y: str, shared_x: str, shared_y: str, percent: int) -> Column:
    """Whether sets of sizes ``x`` and ``y`` can be linked if so many of their shingles are not theirs alone."""
    least = F.ceil((F.col(x) + F.col(y)) * percent / (100 + percent))
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (F.least(shared_x, shared_y) >= least)


def _can_overlap(light: int, percent: int):
    """Whether texts of ``x`` and ``y`` shingles that ``met`` under so many tokens can be linked.

    Up to the last token that the one whose list tokens end first is listed under, both texts' shared tokens are all
    met; of its others all may be shared, which are one less than it must share with any linked text.
    """
    most = F.greatest("x", "y")
    least = -F.floor(-(F.col("x") + F.col("y")) * percent / (100 + percent))
    rest = -F.floor(-most * percent / 100) - 1
    return (F.least("x", "y") < _needed(light + 1, percent)) | (F.col("met") + rest >= least)


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("key"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )


def _grouped(keyed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``id``, ``key``, ``size`` and ``group`` of every row; rows without shingles have no group."""
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(MIN_RANGES, -(-size // RANGE_BYTES))
    made = stage(_measured(keyed, shingle, n_ranges))
    sizes = made.where("size is not null").select(F.nullif("id", F.lit(_LAST)).alias("id"), "key", "size")
    alone = made.where("alone is not null").groupBy("key").agg(F.sum("alone").alias("alone"))
    texts = sizes.groupBy("key").agg(F.first("size").alias("size"), F.min(F.coalesce("id", F.lit(_LAST))).alias("id"))
    shared = F.col("size") - F.coalesce("alone", F.lit(0))
    some = texts.join(alone, "key", "left").where((F.col("size") > 0) & (shared * 100 >= F.col("size") * percent))
    some = stage(some.select("key", "size", "id", shared.alias("shared")))
    # how many texts are left grows with the corpus: they are joined by key at every size, never broadcast
    left = some.select("key", "id", "shared").hint("merge")
    texts = stage(keyed.select("key", "text").join(left, "key").dropDuplicates(["key"]))
    bands = some.groupBy(F.least("size", F.lit(2 * MAX_LIGHT)).alias("size")).count().collect()
    light = light_boundary({r["size"]: r["count"] for r in bands}, percent)
    often = frequencies(texts, shingle, COUNTERS)
    lists = stage(_listed(texts, shingle, percent, light, n_ranges, often))

    # centres of the parts of a dealt list are compared with one of them
    dealt = lists.where("dealt").select("list", *[F.col(f"centre{x}").alias(f"key{x}") for x in ("", "_size", "_shared")]).distinct()
    tops = dealt.groupBy("list").agg(F.min(F.struct("key", "key_size", "key_shared")).alias("top"))
    tops = dealt.join(tops, "list").select(
        "key", F.col("key_size").alias("size"), F.col("key_shared").alias("shared"), F.col("top.key").alias("centre"),
        F.col("top.key_size").alias("centre_size"), F.col("top.key_shared").alias("centre_shared"),
    )
    stars = lists.select(tops.columns).unionByName(tops)
    stars = stars.where((F.col("key") != F.col("centre")) & _linkable("size", "centre_size", "shared", "centre_shared", percent))
    stars = stars.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
    stars = stage(stars)
    links = stage(_verified(stars, texts, shingle, percent))
    roots = components(links)

    # lists of two are settled; the others only where their members are not all together yet
    several = lists.where("members > 2 or dealt").groupBy("list", "key", "size", "shared").agg(F.sum("tokens").alias("tokens"))
    placed = several.join(roots.withColumnRenamed("node", "key"), "key", "left")
    placed = stage(placed.select("list", "key", "size", "shared", "tokens", F.coalesce("root", "key").alias("root")))
    split = placed.groupBy("list").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")
    ).where("low != high")
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    rest = placed.join(split.select("list", tiles.alias("tiles")), "list").join(_parities(texts, shingle), "key")
    rest = rest.withColumn("own", F.pmod("key", F.col("tiles")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rest = rest.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    near = rest.groupBy("list", "low", "high").applyInArrow(
        grams.tidy(_compared(percent)), "a long, b long, x long, y long, tokens long"
    )
    pairs = near.groupBy("a", "b").agg(F.sum("tokens").alias("met"), F.first("x").alias("x"), F.first("y").alias("y"))
    pairs = pairs.where(_can_overlap(light, percent)).select("a", "b").join(stars, ["a", "b"], "left_anti")
    more = stage(_verified(pairs, texts, shingle, percent))
    if not more.isEmpty():
        roots = components(links.union(more))

    whole = sizes.join(roots.withColumnRenamed("node", "key"), "key", "left")
    return whole.select("id", "key", "size", F.when(F.col("size") > 0, F.coalesce("root", "key")).alias("group"))


def link_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` (the least id that links reach) of every row.

    Words lie between white space, A-Z in lower case. A text with fewer than ``shingle`` words is one shingle; null and
    blank texts have none and are linked with nothing. Texts are told apart by a 64-bit hash. ``id`` is a whole number;
    a row without one can link others, but a component of such rows alone has no id. Rows with equal ids are separate
    rows. Other columns are left out.
    """
    whole = _grouped(_keyed(docs, id, text), shingle, percent)
    least = whole.where("group is not null").groupBy("group").agg(F.min("id").alias("least"))
    component = F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("least"))
    return whole.join(least, "group", "left").select(
        F.col("id").alias(id), F.col("size").alias("n_shingles"), component.alias("component_id")
    )


def keep_one(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Rows of ``docs`` without near duplicates: of linked ones the row with the least id stays, a missing id being after
    all others; of rows alike in id and text one stays. Rows without shingles all stay."""
    whole = stage(_grouped(_keyed(docs, id, text), shingle, percent))
    order = F.struct(F.col("id").isNull(), "id", "key")
    kept = whole.where("group is not null").groupBy("group").agg(F.min(order).alias("o"))
    kept = kept.select(F.col("o.id").alias("kept_id"), F.col("o.key").alias("kept_key"))
    rows = docs.select(
        others(docs), F.col(f"`{id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("key", F.xxhash64("text"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    full = rows.where(~blank).drop("text").join(kept, same, "left_semi").dropDuplicates(["id", "key"])
    return full.select("row.*").unionByName(rows.where(blank).select("row.*"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return link_documents(table(spark, folder, "documents"))


#: Pairs of different texts by the shingles they share; components by the least id that is reached.
SQL = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE - 2})]) END AS s
  FROM docs),
alike AS MATERIALIZED (SELECT min(doc_id) AS a, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
held AS MATERIALIZED (SELECT a, len(s) AS n, unnest(s) AS g FROM alike),
links AS MATERIALIZED (
  SELECT x.a, y.a AS b FROM held x JOIN held y ON x.g = y.g AND x.a < y.a
  GROUP BY x.a, y.a, x.n, y.n HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, a FROM alike UNION SELECT r.a, l.b FROM r JOIN both_ways l ON r.b = l.a) SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE least END AS component_id
FROM sets LEFT JOIN alike ON list_sort(sets.s) = alike.s LEFT JOIN reached USING (a)
"""

QUERIES = {"op8_jaccard": Query(query, SQL)}
