"""Byte-level BPE by monoid tree reduction.

A piece that is no token itself is encoded by halves, down to single bytes; two neighbouring encodings are
joined by re-encoding a window of k tokens on either side of the seam, k doubling until both ends of the window are stable. An end is stable if its
two tokens, encoded together, stay those two tokens. That suffices: take the first merge of the greedy
run over the whole bytes that would cross a boundary of two such tokens. Up to it all merges stayed
inside tokens, so the run over just these two tokens does the same ones and would cross as well.
Decoding maps ids to bytes and concatenates them up the same tree.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BoundedCache, sliced, texts
from .tokens import compiled, read_ranks

#: Fixed value: the public pattern, whose pieces start at every single space and newline between words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def greedy(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``data`` by repeatedly merging the lowest-ranked neighbours, leftmost first."""
    n = len(data)
    end, prv = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is data[i:end[i]]; end 0: merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != to:
            continue
        end[i], end[j] = to, 0
        if to < n:
            prv[to] = i
            if (r := ranks.get(data[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (h := prv[i]) >= 0 and (r := ranks.get(data[h:to])) is not None:
            heapq.heappush(heap, (r, h, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = end[i]
    return out


class TreeCodec:
    """Encodes and decodes whole texts; every match of ``pattern`` is encoded on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.pieces = compiled(pattern).findall
        # only of that pattern it is known how it parts words; any other takes the plain way
        self._by_words = pattern == WORD_PATTERN
        self.joins = 0
        self._node = BoundedCache(self.reduce, longest=8)  # small nodes of the tree are remembered
        self._stable = BoundedCache(lambda pair: greedy(self.token[pair[0]] + self.token[pair[1]], ranks) == [*pair])
        self._packed = BoundedCache(lambda piece: np.array(self.piece(piece.encode()), "<u4").tobytes())
        # words by whether a space stands before them; None: how it splits depends on what is around it
        self._words = [BoundedCache(lambda w, space=space: self._word(space, w)) for space in ("", " ")]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes, given the encoding of each."""
        self.joins += 1
        if not left or not right or self._stable[left[-1], right[0]]:
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            middle = greedy(b"".join(map(self.token.__getitem__, left[a:] + right[:b])), self.ranks)
            if (a == 0 or self._stable[left[a - 1], middle[0]]) and (b == len(right) or self._stable[middle[-1], right[b]]):
                return left[:a] + middle + right[b:]
            k *= 2

    def reduce(self, data: bytes) -> list[int]:
        """The encoding of bytes, up a tree of joins. Halves are cut at powers of two, so that long repeats meet in step."""
        if len(data) < 2:
            return [self.ranks[data]] if data else []
        half = 1 << ((len(data) - 1).bit_length() - 1)
        return self.join(self._node[data[:half]], self._node[data[half:]])

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece: its own, if it is a token, as the library has it; else the tree's."""
        return [self.ranks[data]] if data in self.ranks else self.reduce(data)

    def _word(self, space: str, word: str) -> bytes | None:
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return b"".join(map(self._packed.__getitem__, self.pieces(space + word)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Pieces never merge, so the tree above them concatenates.

        In WORD_PATTERN, white space is in a piece with what is not only as a single space before it. So where
        single spaces and newlines part words that neither start nor end in white space, a piece starts at each
        of them (a newline is one piece, a space belongs to the word behind it), and no contraction reaches over
        one. Remembered words can then be put together.
        """
        if not self._by_words:
            return b"".join(map(self._packed.__getitem__, self.pieces(text)))
        first, later = (w.__getitem__ for w in self._words)
        newline, out = self._packed["\n"], []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first(words[0]))
            out += map(later, words[1:])
            out.append(newline)
        out.pop()
        if None in out:
            return b"".join(map(self._packed.__getitem__, self.pieces(text)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids, concatenated by halves above leaves of 4096 ids."""
        if len(ids) <= 4 * 4096:
            return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        half = len(ids) // 8 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) per row of ``df``; ``keep_ids`` adds the ids as array<int>.

    Null texts count as empty: no ids, digests of no bytes. Null ids and repeated rows pass through, one
    row each; other columns are not read. An empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(read_ranks(ranks_path), pattern)
        for batch in sliced(batches, 128):
            ids = [codec.encode(t) for t in texts(batch, text_col)]
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]),
            ]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype("int32") for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(id_col, text_col).mapInArrow(run, schema + ", ids array<int>" * keep_ids)
