"""Token ids of whole texts by a tokenizer file of the tokenizers library."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lodeglass.llm import grams

#: Pieces that a worker remembers; beyond, it goes on with those of the batch at hand.
REMEMBERED = 500_000
#: Bytes of texts that are encoded at once.
AT_ONCE = 2 << 20
_ALNUM, _MARK, _GAP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?")] = True
_GAP[list(b" \n")] = True


class Encoder:
    """Encodes batches of texts piece by piece, and each piece once while it is remembered.

    For tokenizers that fold case, drop white space and part letters and digits from other characters. There the ids of
    a text are those of its pieces: spaces and line breaks part tokens, so does what stands between an ASCII letter or
    digit and a mark that ends a word, and A-Z have the ids of a-z. Only where a batch may hold a special token's
    text is case kept. Pieces are told apart by 64-bit hashes. ``tests/llm`` holds the ids against those of whole texts.
    ``end`` closes each text.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._end = end
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        self._closes = np.zeros(self._tokenizer.get_vocab_size(), bool)
        for token, id in self._tokenizer.get_vocab().items():
            self._closes[id] = bool(suffix) and token.endswith(suffix)
        # what is remembered: hashes in order, and where among the ids each one's begin and how many they are
        self._hashes, self._begin = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._size, self._ids = np.empty(0, np.int32), np.empty(0, "<u4")

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with its end, and where each text's begin."""
        mark = _MARK[data]
        mark[1:] &= _ALNUM[data[:-1]]
        mark[:1] = False
        after = np.ones(len(data), bool)
        after[:-1] = _GAP[data[1:]]
        edges = bounds[1:-1]
        after[edges[edges > 0] - 1] = True
        mark &= after
        mark[edges[edges < len(data)]] = False
        special = b"<|" in data.tobytes()
        pieces = grams.Words(data, bounds, folded=not special, gaps=_GAP, cuts=np.flatnonzero(mark))
        hashes = pieces.hash ^ np.uint64(special)
        order = np.argsort(hashes, kind="stable")
        at = grams.runs(hashes[order])
        which = np.empty(len(hashes), np.int64)
        which[order] = np.repeat(np.arange(len(at) - 1), np.diff(at))
        first = order[at[:-1]]
        begins, sizes = self._looked_up(data, pieces.start[first], pieces.end[first], hashes[first])
        own = sizes[which].astype(np.int64)
        ends = np.cumsum(own)
        out = self._ids[np.repeat(begins[which] - (ends - own), own) + np.arange(int(own.sum()))]
        starts = np.append(0, ends)[pieces.first]
        return np.insert(out, starts[1:], self._end), starts + np.arange(len(bounds))

    def _looked_up(
        self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of pieces with these hashes, which are in order, begin, and how many they are."""
        at = np.searchsorted(self._hashes, hashes)
        missing = np.ones(len(hashes), bool)
        inside = at < len(self._hashes)
        missing[inside] = self._hashes[at[inside]] != hashes[inside]
        if missing.any():
            texts = [bytes(data[a:b]).decode() for a, b in zip(start[missing], end[missing], strict=True)]
            found = self._encoded(texts)
            sizes = np.array([len(x) // 4 for x in found], np.int32)
            begins = len(self._ids) + np.cumsum(sizes, dtype=np.int64) - sizes
            self._hashes = np.insert(self._hashes, at[missing], hashes[missing])
            self._begin = np.insert(self._begin, at[missing], begins)
            self._size = np.insert(self._size, at[missing], sizes)
            self._ids = np.append(self._ids, np.frombuffer(b"".join(found), "<u4"))
            at = np.searchsorted(self._hashes, hashes)
        if len(self._hashes) > REMEMBERED:
            begins, sizes = self._begin[at], self._size[at].astype(np.int64)
            ends = np.cumsum(sizes)
            self._ids = self._ids[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
            self._hashes, self._begin, self._size = hashes, ends - sizes, sizes.astype(np.int32)
            at = np.arange(len(hashes))
        return self._begin[at], self._size[at]

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Plain words go many at a time where the tokenizer marks each word's last token."""
        out: list[bytes] = [b""] * len(pieces)
        plain = [k for k, x in enumerate(pieces) if x.isalpha()]
        single = [k for k, x in enumerate(pieces) if not x.isalpha()]
        for low in range(0, len(plain), 500):
            own = plain[low : low + 500]
            text = " ".join([pieces[k] for k in own])
            ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self._closes[ids]) + 1
            if len(cuts) != len(own):
                single += own
                continue
            data, at = ids.tobytes(), 0
            for k, to in zip(own, (cuts * 4).tolist(), strict=True):
                out[k], at = data[at:to], to
        if single:
            found = self._tokenizer.encode_batch_fast([pieces[k] for k in single], add_special_tokens=False)
            for k, x in zip(single, found, strict=True):
                out[k] = np.array(x.ids, "<u4").tobytes()
        return out


def _encoder(path: str, end: int) -> Encoder:
    """The worker's encoder. Functions reach a worker anew with each task, but a module stays while the worker lives."""
    kept = sys.modules.setdefault("_lodeglass_kept", types.ModuleType("_lodeglass_kept")).__dict__
    if (path, end) not in kept:
        kept[path, end] = Encoder(path, end)
    return kept[path, end]


def encoded(
    rows: Iterator[pa.RecordBatch], path: str, end: int, text: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the ids of all their texts and where each text's begin, null being empty."""
    encoder = _encoder(path, end)
    for batch, data, bounds in grams.batches(rows, text, AT_ONCE):
        yield batch, *encoder.encode(data, bounds)
