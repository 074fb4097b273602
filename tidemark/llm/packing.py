"""Best-fit packing of tokenised documents into sequences with several capacities.

Documents are tokenised and cut in one scan that emits one short row for each piece. The pieces are
dealt into lots of bounded size, each lot is packed by one task with vector best-fit decreasing, and
nothing but (doc, piece, length, checksum) moves. A lot leaves one sequence badly filled at most,
so the loss against one packing of everything is below one sequence in a thousand.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage, text_slices

#: Pieces that one task packs together.
LOT_PIECES = 8_192
#: Words that a generation of a worker's cache holds before it ages.
CACHE_WORDS = 300_000

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class TokenIds:
    """The ids of texts, as little-endian unsigned 32-bit bytes, by a tokenizer file whose normaliser
    lower-cases and whose words end at white space: so a text's ids are its words' ids.

    Words met before come from a cache of two generations, so that frequent ones stay when it fills up.
    New words are split as the tokenizer's own pattern splits them and their parts are encoded in one batch."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.final[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def parts(self, word: bytes) -> list[str]:
        """The parts that the tokenizer's pattern gives; the word as it is where that isn't certain:
        special tokens, and the one letter whose lower case is no letter only. Letters alone, and
        letters before one mark, need no pattern."""
        text = word.decode("utf-8", "replace")
        if "<|" in text or "\u0130" in text:
            return [text]
        if text.isalpha():
            return [text]
        if text[-1] in ".,;:!?" and (head := text[:-1]).isalpha():
            return [head, text[-1]]
        return _PIECES.findall(text if text.isascii() else unicodedata.normalize("NFC", text))

    def fresh(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of parts, a few hundred to a call: each ends with the call's next word-final id.
        Where their number shows that a part is several words to the tokenizer, parts go one by one."""
        found: dict[str, bytes] = {}
        groups = [parts[i : i + 200] for i in range(0, len(parts), 200)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(group) and (not len(ids) or ends[-1] == len(ids)):
                data, start = ids.tobytes(), 0
                for part, end in zip(group, (4 * ends).tolist(), strict=True):
                    found[part], start = data[start:end], end
            else:
                for part, one in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False), strict=True):
                    found[part] = np.array(one.ids, "<u4").tobytes()
        return found

    def learn(self, words: set[bytes]) -> None:
        """Puts the ids of all words into the young generation."""
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        split: dict[bytes, list[bytes]] = {}
        young, old, unknown = self.young, self.old, set()
        for word in words.difference(young):
            value = old.get(word)
            if value is not None:
                young[word] = value
                continue
            ps = [p.encode() for p in self.parts(word)]
            if ps != [word]:
                split[word] = ps
            unknown.update(ps)
        # parts are words of the cache too: of a word and its forms with marks, letters are encoded once
        for p in [p for p in unknown if p in young or p in old]:
            unknown.discard(p)
            if p not in young:
                young[p] = old[p]
        for p, ids in self.fresh([p.decode() for p in unknown]).items():
            young[p.encode()] = ids
        for word, ps in split.items():
            young[word] = b"".join([young[p] for p in ps])

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        split = [(t or b"").lower().split() for t in texts]
        self.learn(set().union(*split))
        for words in split:
            yield b"".join(map(self.young.__getitem__, words))


_LOADED: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
    return _LOADED[path]


def _cutter(path: str, size: int, end: int) -> Callable:
    end_bytes = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, slot = token_ids(path), 0
        for batch in batches:
            for first, texts in text_slices(batch, "text"):
                rows: list[tuple] = []
                for i, found in enumerate(ids.encode(texts)):
                    data = found + end_bytes
                    for piece, at in enumerate(range(0, len(data), 4 * size)):
                        part = data[at : at + 4 * size]
                        rows.append((first + i, piece, at // 4, len(part) // 4, zlib.crc32(part), slot))
                        slot += 1
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(columns[0]), columns[1].cast(pa.int32()), *columns[2:]], names=["doc_id", "piece", "start", "length", "ids_crc32", "slot"])

    return cut


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, slot): each document's ids and end_id, cut into
    pieces of size ids; only the last may be shorter. slot numbers the pieces of one task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cutter(tokenizer_path, size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, slot long")


def best_fit(items: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, int]:
    """The bin of each item and the number of bins: vector best-fit decreasing.

    items: n x d loads, capacity: d. Items go by falling weighted share of the capacity. Of the open
    bins where every residual suffices, rule "norm" takes that with the smallest weighted norm of
    what would be left, "dot" that with the largest weighted dot product of load and residual; a tie
    goes to the oldest bin. If none fits, a bin is opened. Bins whose residual in any dimension is
    below every item's are closed. Raises ValueError for an item over the capacity."""
    if len(items) and (items > capacity).any():
        raise ValueError("an item exceeds a capacity")
    share = items / capacity
    order = np.lexsort((np.arange(len(items)), -(share * weights).sum(axis=1)))
    least = items.min(axis=0) if len(items) else capacity
    where = np.empty(len(items), np.int64)
    room = np.empty((max(1, len(items)), len(capacity)))
    name = np.empty(max(1, len(items)), np.int64)
    live = opened = 0
    for i in order:
        at, residual = -1, room[:live]
        fits = np.flatnonzero((residual >= items[i]).all(axis=1))
        if len(fits):
            left = residual[fits]
            if rule == "norm":
                score = (((left - items[i]) / capacity) ** 2 * weights).sum(axis=1)
                at = fits[np.argmin(score)]
            else:
                score = ((left / capacity) * share[i] * weights).sum(axis=1)
                at = fits[np.argmax(score)]
        if at < 0:
            at, room[live], name[live] = live, capacity, opened
            live, opened = live + 1, opened + 1
        where[i] = name[at]
        room[at] -= items[i]
        if (room[at] < least).any():  # nothing fits any more: the bin leaves, the others keep their order
            room[at : live - 1], name[at : live - 1] = room[at + 1 : live].copy(), name[at + 1 : live].copy()
            live -= 1
    return where, opened


def _packer(capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> Callable:
    def pack(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["length", "slot", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        n = lot["length"].to_numpy(np.float64)
        where, _ = best_fit(np.stack([n, np.ones(len(n)), n * n], axis=1), np.array(capacity, np.float64), np.array(weights, np.float64), rule)
        order = np.argsort(where, kind="stable")
        lot, where, n = lot.iloc[order], where[order], lot["length"].to_numpy()[order]
        before = np.cumsum(n) - n
        starts = np.r_[True, where[1:] != where[:-1]] if len(where) else np.empty(0, bool)
        lot = lot.assign(sequence_id=(lot["lot"].to_numpy() << 24) | where, offset=before - np.maximum.accumulate(np.where(starts, before, 0)))
        return lot[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return pack


def pack_pieces(pieces: DataFrame, tokens: int = 2048, documents: int | None = None, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), rule: str = "norm") -> DataFrame:
    """pieces with (sequence_id, offset). Three capacities hold in each sequence: ids, number of
    pieces, and attention cost (sum of squared lengths). Without a value, documents and attention
    are as large as tokens ids can need, so that they never cost a sequence."""
    capacity = (tokens, documents or tokens, attention or float(tokens) ** 2)
    n = pieces.count()
    lots = max(1, -(-n // LOT_PIECES))
    dealt = pieces.withColumn("lot", F.pmod(F.xxhash64("doc_id", "piece", "slot", "ids_crc32"), F.lit(lots)))
    return dealt.groupBy("lot").applyInPandas(_packer(capacity, weights, rule), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    Edge cases: a null or empty text is the end id alone; a text over size ids is cut, shorter ones
    never; null doc_ids and repeated rows are packed as rows of their own; an empty table gives an
    empty table; other columns are ignored. An attention or document capacity that a full piece
    exceeds raises ValueError."""
    return pack_pieces(stage(token_pieces(docs, tokenizer_path, size, end_id), "pieces"), size, **options)
