"""Byte-level BPE of whole columns, merged in padded matrices.

Texts are cut into pieces by the tokenizer's pattern; the distinct pieces of a
batch are encoded together. Pieces of like length share a padded matrix of
token ids. Each round every row merges its leftmost pair of least rank; ranks
of pairs come from an open-addressing hash table of the vocabulary, looked up
for a whole matrix at once, and only next to a merge again. Rows with nothing
left to merge leave the matrix, and its columns are closed up when half of them
are empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that the public byte-level BPE vocabularies were
#: made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_NONE = np.int32(2**31 - 1)
_CACHE_PIECES = 1 << 18
_MATRIX_CELLS = 1 << 20


class PairTable:
    """Pair of token ids -> id of their merge, by open addressing."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(pairs) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ids = np.full(1 << bits, _NONE, dtype=np.int32)
        left = np.arange(len(pairs))
        slot = self._slot(pairs)
        while len(left):
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = pairs[left[free]]  # of several, the last one stays
            stored = self.keys[slot[left]] == pairs[left]
            self.ids[slot[left[stored]]] = merged[left[stored]]
            left = left[~stored]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, which are ranks too; ``_NONE`` for pairs that never merge.

        Negative ids stand for padding and never merge.
        """
        pairs = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(pairs.shape, _NONE, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        flat, target = pairs.ravel(), out.ravel()
        slot = self._slot(flat[todo])
        while len(todo):
            found = self.keys[slot]
            hit = found == flat[todo]
            target[todo[hit]] = self.ids[slot[hit]]
            on = ~hit & (found != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return target.reshape(pairs.shape)


class ByteBpe:
    """An encoder over a rank file: lines of base64 bytes and rank."""

    def __init__(self, rank_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.n_vocab = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(pairs, dtype=np.int64), np.array(merged, dtype=np.int32))
        self.pattern = regex.compile(PATTERN)
        self.whole = {token: np.array([rank], dtype=np.int32) for token, rank in ranks.items()}
        self._known: dict[str, np.ndarray] = {}

    def _merge(self, ids: np.ndarray) -> list[np.ndarray]:
        """Encode the rows of a padded matrix (-1 pads the right end)."""
        n = len(ids)
        done: list[np.ndarray] = [None] * n
        rows = np.arange(n)
        while len(rows):
            width = ids.shape[1]
            at = np.arange(len(rows))
            after = np.broadcast_to(np.arange(1, width + 1), ids.shape).copy()
            before = np.broadcast_to(np.arange(-1, width - 1), ids.shape).copy()
            ranks = np.full(ids.shape, _NONE, dtype=np.int32)
            ranks[:, :-1] = self.pairs.get(ids[:, :-1], ids[:, 1:])
            alive = (ids >= 0).sum(axis=1)
            while True:
                best = ranks.argmin(axis=1)
                rank = ranks[at, best]
                open_ = rank != _NONE
                if not open_.all():
                    for r in np.flatnonzero(~open_):
                        done[rows[r]] = ids[r][ids[r] >= 0]
                    rows, ids, ranks, alive = rows[open_], ids[open_], ranks[open_], alive[open_]
                    after, before, best, rank = after[open_], before[open_], best[open_], rank[open_]
                    at = np.arange(len(rows))
                    if not len(rows):
                        break
                # Merge: the left cell takes the merged id, the right one dies.
                gone = after[at, best]
                right = after[at, gone]
                ids[at, best] = rank
                ids[at, gone] = -1
                ranks[at, gone] = _NONE
                after[at, best] = right
                ends = right >= width
                inner = np.minimum(right, width - 1)
                before[at[~ends], inner[~ends]] = best[~ends]
                ranks[at, best] = np.where(ends, _NONE, self.pairs.get(rank, np.where(ends, -1, ids[at, inner])))
                left = before[at, best]
                has = left >= 0
                ranks[at[has], left[has]] = self.pairs.get(ids[at[has], left[has]], rank[has])
                alive -= 1
                if alive.max() * 2 <= width:
                    keep = ids >= 0
                    packed = np.full((len(rows), int(alive.max())), -1, dtype=np.int32)
                    packed[np.nonzero(keep)[0], (np.cumsum(keep, axis=1) - 1)[keep]] = ids[keep]
                    ids = packed
                    break
        return done

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece; lone surrogates are replaced as UTF-8 does."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        out: list[np.ndarray] = [self.whole.get(b) for b in raw]
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if out[i] is None:
                buckets.setdefault(max(2, len(b) - 1).bit_length(), []).append(i)
        for members in buckets.values():
            width = max(len(raw[i]) for i in members)
            step = max(1, _MATRIX_CELLS // width)
            for start in range(0, len(members), step):
                chosen = members[start : start + step]
                lengths = np.array([len(raw[i]) for i in chosen])
                ids = np.full((len(chosen), int(lengths.max())), -1, dtype=np.int32)
                flat = np.frombuffer(b"".join(raw[i] for i in chosen), dtype=np.uint8)
                ids[np.arange(ids.shape[1]) < lengths[:, None]] = self.byte_ids[flat]
                for i, got in zip(chosen, self._merge(ids)):
                    out[i] = got
        return out

    def encode_batch(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts; a null or empty text has no ids."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        known = self._known
        new = list({p for pieces in cut for p in pieces if p not in known})
        if len(known) + len(new) > _CACHE_PIECES:  # results don't depend on it
            known = self._known = {}
            new = list({p for pieces in cut for p in pieces})
        known.update(zip(new, self.encode_pieces(new)))
        parts = [known[p] for pieces in cut for p in pieces]
        sizes = np.fromiter((len(x) for x in parts), dtype=np.int64, count=len(parts))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.fromiter((len(p) for p in cut), dtype=np.int64, count=len(cut))
        offsets = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        if len(known) > _CACHE_PIECES:
            self._known = {}
        return offsets, ids


_ENCODERS: dict[int, ByteBpe] = {}


def _encoder(rank_file: bytes) -> ByteBpe:
    """One encoder per Python worker and vocabulary."""
    key = hash(rank_file)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteBpe(rank_file)
    return _ENCODERS[key]


def _ranks(df: DataFrame, vocabulary: str):
    """The rank file, read by the driver and sent once to each executor (under 1 MB)."""
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col`` and ids, the token ids of each whole text, row by row.

    Without special tokens: their strings in a text are ordinary text. Null and
    empty texts have an empty list. Repeated rows come out repeated.
    """
    ranks = _ranks(df, vocabulary)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(ranks.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                offsets, ids = bpe.encode_batch(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col`` and n_tokens, as ``encode`` would count them."""
    ranks = _ranks(df, vocabulary)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(ranks.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                offsets, _ = bpe.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64())], names=[id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def token_totals(df: DataFrame, by: str) -> DataFrame:
    """Documents and tokens by a column of a table with n_tokens."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
