"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

A word's count is its initial symbols minus the merges done on it. Words are counted once per worker
and remembered, so cost follows distinct words; the scan is one narrow stage without a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BoundedCache, sliced, texts
from .tokens import WordVocabulary, word_vocabulary


def merges_done(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How often the lowest-ranked adjacent pair (leftmost on ties) can be merged, in O(n log n).

    ``nxt`` and ``prv`` link the symbols that are left; a heap entry is stale once either symbol changed.
    """
    n = len(symbols)
    sym = list(symbols)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, sym[i], sym[i + 1]) for i in range(n - 1) if (rank := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = nxt[i] if sym[i] is not None else n
        if j >= n or sym[i] != left or sym[j] != right:
            continue
        sym[i], sym[j] = left + right, None
        nxt[i] = k = nxt[j]
        done += 1
        if k < n:
            prv[k] = i
            if (rank := ranks.get((sym[i], sym[k]))) is not None:
                heapq.heappush(heap, (rank, i, sym[i], sym[k]))
        if (h := prv[i]) >= 0 and (rank := ranks.get((sym[h], sym[i]))) is not None:
            heapq.heappush(heap, (rank, h, sym[h], sym[i]))
    return done


class TokenCounter:
    """Counts the tokens of whole texts as the vocabulary's own library would."""

    def __init__(self, vocabulary: WordVocabulary):
        self.v = vocabulary
        self.of_word = BoundedCache(self._count)
        self.of_chunk = BoundedCache(lambda chunk: sum(map(self.of_word.__getitem__, vocabulary.words(chunk))))

    def _count(self, word: str) -> int:
        symbols = self.v.symbols(word)
        return len(symbols) - merges_done(symbols, self.v.merges)

    def count(self, text: str) -> int:
        n, of_chunk = 0, self.of_chunk.__getitem__
        for segment in self.v.segments(text):
            n += 1 if segment in self.v.special else sum(map(of_chunk, self.v.chunks(segment)))
        return n


def count_tokens(df: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``df``.

    Null and empty texts have 0 bytes and 0 tokens. Null ids, repeated rows and ties pass through, one row
    each; other columns are not read. An empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(word_vocabulary(vocabulary_path))
        for batch in sliced(batches, 1024):
            found = texts(batch, text_col)
            tokens = [counter.count(t) for t in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) if t.isascii() else len(t.encode()) for t in found], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
