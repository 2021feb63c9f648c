"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every document is cut into full windows and a rest; each rest goes, as it comes, to the fill level that
minimises the sum over levels of squared counts of partly filled windows, kept in one array of counts.
Cutting is free, so windows can be filled from one another, the fullest from the emptiest: one at a time while
more than ``MAX_OPEN`` are open, and all at the end of a task, where at most one stays short.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import BoundedCache, kept, sliced, texts
from .tokens import WordVocabulary, byte_letters

#: Windows held open by a task, which bounds its memory; one more makes the fullest leave, filled from the emptiest.
MAX_OPEN = 4096

Piece = tuple[object, int, bytes, int]  # document id, start, ids, document's tokens


class WordIds:
    """The ids of whole texts by a word-end BPE file, as little-endian unsigned 32-bit integers.

    An ASCII word is the only word of itself as a chunk, so chunks and ASCII words share one memo.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocabulary, self._tokenize, self._letters = WordVocabulary(path), Tokenizer.from_file(path).model.tokenize, byte_letters()
        self.special = {s: struct.pack("<I", i) for s, i in self.vocabulary.special.items()}
        self.of_chunk = BoundedCache(self._chunk)
        self._other = BoundedCache(self._word)  # words that are not ASCII

    def _word(self, word: str) -> bytes:
        # visible ASCII letters stand for themselves
        if not (word.isascii() and word.isprintable()):
            word = "".join([self._letters[b] for b in word.encode()])
        ids = [t.id for t in self._tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        words = self.vocabulary.words(chunk)
        if len(words) == 1 and words[0] == chunk:
            return self._word(chunk)
        of_chunk, other = self.of_chunk, self._other
        return b"".join([of_chunk[w] if w.isascii() else other[w] for w in words])

    def __call__(self, text: str, tail: bytes = b"") -> bytes:
        out: list[bytes] = []
        for segment in self.vocabulary.segments(text):
            if segment in self.special:
                out.append(self.special[segment])
            else:
                out += map(self.of_chunk.__getitem__, self.vocabulary.chunks(segment))
        out.append(tail)
        return b"".join(out)


def word_ids(path: str) -> WordIds:
    """Kept for a worker's later tasks, whose texts hold the same words."""
    return kept(("word_ids", path), lambda: WordIds(path))


class SumOfSquares:
    """Packs pieces of at most ``size`` ids; ``place`` and ``finish`` return the windows that are complete."""

    def __init__(self, size: int, max_open: int = MAX_OPEN):
        self.size, self.max_open = size, max_open
        self.count = np.zeros(size + 1, np.int64)  # of open windows at each fill level
        self.open: dict[int, list[list[Piece]]] = {}  # the windows at each level
        self.n_open = 0

    def level_for(self, length: int) -> int:
        """The level, 0 for a new window, whose choice leaves the least sum of squares; the fullest on ties."""
        size, count = self.size, self.count
        levels = np.flatnonzero(count[: size - length + 1])
        target = count[levels + length]
        # moving one window from level h to h + length changes the sum by 1 - 2 N(h) + [1 + 2 N(h + length)]
        change = 1 - 2 * count[levels] + np.where(levels + length < size, 1 + 2 * target, 0)
        fresh = 1 + 2 * count[length] if length < size else 0
        if not len(levels) or fresh < change.min():
            return 0
        return int(levels[len(levels) - 1 - np.argmin(change[::-1])])

    def place(self, piece: Piece) -> list[list[Piece]]:
        length = len(piece[2]) // 4
        level = self.level_for(length)
        if level:
            window = self._taken(level)
        else:
            window = []
        window.append(piece)
        if level + length == self.size:
            return [window]
        self._keep(window, level + length)
        return self._pour() if self.n_open > self.max_open else []

    def _keep(self, window: list[Piece], level: int) -> None:
        self.open.setdefault(level, []).append(window)
        self.count[level] += 1
        self.n_open += 1

    def _taken(self, level: int) -> list[Piece]:
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _pour(self) -> list[list[Piece]]:
        """Fill the fullest open window from the emptiest ones. It is returned once complete, and stays open otherwise."""
        level = int(np.flatnonzero(self.count)[-1])
        window = self._taken(level)
        while level < self.size and self.n_open:
            lowest = int(np.flatnonzero(self.count)[0])
            spare, left = self._taken(lowest), lowest
            while spare and level < self.size:
                doc, start, ids, total = spare.pop()
                take = min(self.size - level, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], total))
                level += take
                left -= take
                if 4 * take < len(ids):
                    spare.append((doc, start + take, ids[4 * take :], total))
            if spare:
                self._keep(spare, left)
        if level < self.size:
            self._keep(window, level)
            return []
        return [window]

    def finish(self) -> list[list[Piece]]:
        """The open windows, poured into one another; at most one of them is short."""
        done = []
        while self.n_open:
            done += self._pour() or [self._taken(int(np.flatnonzero(self.count)[-1]))]
        return done


def pack(df: DataFrame, tokenizer_path: str, *, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Each row of ``df`` is a document: its ids by the tokenizer, then ``end_id``. Null and empty texts are
    the end id alone. Tasks pack on their own, without a shuffle; a sequence's number holds the task's
    number above 2^32, so a task that is run again gives the same rows. Repeated rows are packed each;
    null ids stay null; other columns are not read; an empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_path)
        tail, packer = np.array([end_id], "<u4").tobytes(), SumOfSquares(window)
        number = TaskContext.get().partitionId() << 32

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in range(8)]
            for w in windows:
                offset = 0
                for doc, start, ids, total in w:
                    n = len(ids) // 4
                    for column, value in zip(out, (doc, start, n, zlib.crc32(ids), total, number, offset, ids), strict=True):
                        column.append(value)
                    offset += n
                number += 1
            arrays = [pa.array(out[0], ids_type), *(pa.array(c, pa.int64()) for c in out[1:7])]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype("int32") for x in out[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

        ids_type = None
        step = 4 * window
        for batch in sliced(batches, 128, keeps=("word_ids", tokenizer_path)):
            ids_type = batch.schema.field(0).type
            done: list[list[Piece]] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch, text_col), strict=True):
                ids = ids_of(text, tail)
                total = len(ids) // 4
                for at in range(0, len(ids), step):
                    piece = (doc, at // 4, ids[at : at + step], total)
                    done += [[piece]] if len(piece[2]) == step else packer.place(piece)
            if done:
                yield rows(done)
        if ids_type is not None and (done := packer.finish()):
            yield rows(done)

    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return df.select(id_col, text_col).mapInArrow(run, schema + ", ids array<int>" * keep_ids)
