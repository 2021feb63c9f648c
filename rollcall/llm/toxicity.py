"""Toxicity by compression distance to two zstandard dictionaries.

One dictionary is trained on toxic texts, the other on ordinary ones. Windows are overlapping spans of
running text, SPAN bytes long, each compressed twice: with the ordinary dictionary, and with the toxic one
put behind it, so that both know ordinary text alike and what the second saves is due to toxic text. A window
counts as toxic if the ordinary dictionary leaves it longer than most and the toxic one saves enough; both
thresholds are calibrated. A text's evidence is what is saved beyond the threshold, per window, turned into
a probability by isotonic regression. Thresholds and calibration come from labelled
texts that trained neither dictionary.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import Isotonic
from .common import agreed_labels, filtered, materialise, sliced, texts

#: Labelled rows of either class that are learned from at most (about), three quarters for the dictionaries, one for calibration.
ROWS_PER_CLASS = 6000
#: Bytes of either class that its dictionary is trained on at most (about), in samples of CHUNK bytes.
TRAIN_BYTES, CHUNK = 16 << 20, 1000
#: Sizes of the dictionaries, and lengths of the segments and of the strings by whose frequency segments are chosen.
TOXIC, ORDINARY = (64 << 10, 16, 8), (512 << 10, 32, 8)
SPAN, STEP = 48, 36
#: Share of ordinary windows that the ordinary dictionary makes shorter than any that can be toxic.
PLAIN = 0.75
#: Thresholds, in bytes saved, that calibration chooses from.
SAVED = range(2, 17)
#: Stands behind each window, and at the end of each dictionary: zstandard looks for no match in a block's
#: last bytes, and stores short blocks as they are.
ANCHOR = bytes(range(0x30, 0x3C))


def spans(data: bytes) -> Iterator[bytes]:
    """Windows that cover the whole text; none of an empty one."""
    if data:
        for at in range(0, max(1, len(data) - (SPAN - STEP)), STEP):
            yield data[at : at + SPAN]


def dictionary(chunks: list[bytes], size: int, segment: int, string: int) -> bytes:
    """A dictionary trained on the chunks; of too few to train on, the chunks themselves."""
    random.Random(5).shuffle(chunks)
    try:
        return zstd.train_dictionary(size, chunks, k=segment, d=string).as_bytes()
    except zstd.ZstdError:
        return b"".join(chunks)[-size:].rjust(8, b"\0")


def compressor(content: bytes) -> zstd.ZstdCompressor:
    parameters = zstd.ZstdCompressionParameters(
        window_log=21, hash_log=18, chain_log=19, search_log=2, min_match=5, target_length=16, strategy=zstd.STRATEGY_BTOPT,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    data = zstd.ZstdCompressionDict(content + ANCHOR)
    data.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=data, compression_params=parameters)


class Distance:
    """Windows' lengths with the ordinary dictionary, and what the toxic one saves on them."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.ordinary, self.both = compressor(ordinary).compress, compressor(ordinary + toxic).compress

    def lengths(self, text: str) -> list[int]:
        return [len(self.ordinary(window + ANCHOR)) for window in spans(text.lower().encode())]

    def excess(self, text: str, long: int, least: int) -> tuple[int, np.ndarray]:
        """(number of windows, bytes that the ``long`` ones save from the ``least``-th on, from the next on, and so on up to SAVED's end)."""
        n, saved = 0, np.zeros(SAVED.stop - least, np.int64)
        ordinary, both = self.ordinary, self.both
        for window in spans(text.lower().encode()):
            n += 1
            window += ANCHOR
            length = len(ordinary(window))
            if length >= long and (more := length - len(both(window)) - least) >= 0:
                saved[min(more, len(saved) - 1)] += 1
        return n, saved[::-1].cumsum().cumsum()[::-1]


def evidence(windows: np.ndarray, excess: np.ndarray) -> np.ndarray:
    """Bytes saved beyond the threshold per window, with some windows more against chance in short texts."""
    return excess / (10 + windows)


class Model:
    def __init__(self, toxic: bytes, ordinary: bytes, long: int, saved: int, calibrated: Isotonic):
        self.toxic, self.ordinary, self.long, self.saved, self.calibrated = toxic, ordinary, long, saved, calibrated

    def scorer(self):
        """A function from texts to their probabilities."""
        distance = Distance(self.toxic, self.ordinary)

        def score(found: list[str]) -> np.ndarray:
            counted = [distance.excess(t, self.long, self.saved) for t in found]
            return self.calibrated(evidence(np.array([n for n, _ in counted]), np.array([e[0] for _, e in counted], float)))

        return score


def fit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from ``labels`` (id, 0/1) and the texts of ``df``; at most about ROWS_PER_CLASS rows of either class, taken by hash.

    Ids that are null or have both labels are not learned from.
    """
    known = agreed_labels(labels, id_col, label_col)
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = {y: min(1.0, ROWS_PER_CLASS / max(1, totals.get(y, 0))) for y in (0, 1)}
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_000)) / 1e6
    sample = known.where(place < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).withColumn("fits", F.pmod(F.xxhash64(F.col(id_col), F.lit(29)), F.lit(4)) > 0)
    # of bounded size: about 2 * ROWS_PER_CLASS ids
    chosen = materialise(df.select(id_col, text_col).join(F.broadcast(sample), id_col).select("y", "fits", F.col(text_col).alias("text")))
    sizes = {r["y"]: r["bytes"] for r in chosen.where("fits").groupBy("y").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    parts = {y: min(1.0, TRAIN_BYTES / max(1, sizes.get(y) or 0)) * (1 << 32) for y in (0, 1)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            found = [
                (y, chunk)
                for y, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True)
                for data in [text.lower().encode()]
                for at in range(0, len(data), CHUNK)
                if zlib.crc32(chunk := data[at : at + CHUNK]) < parts[y]
            ]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], names=["y", "chunk"])

    # of bounded size: about 2 * TRAIN_BYTES; copies of a text count once
    chunks = chosen.where("fits").select("y", "text").mapInArrow(cut, "y int, chunk binary").distinct().toArrow()
    by = [[], []]
    for y, chunk in zip(chunks.column(0).to_pylist(), chunks.column(1).to_pylist(), strict=True):
        by[y].append(chunk)
    toxic, ordinary = (dictionary(sorted(by[y]), *sizes) for y, sizes in ((1, TOXIC), (0, ORDINARY)))
    rest = chosen.where("not fits").select("y", "text")
    return calibrated(rest, toxic, ordinary, share, totals.get(1, 0) / max(1, sum(totals.values())))


def calibrated(rest: DataFrame, toxic: bytes, ordinary: bytes, share: dict[int, float], prior: float) -> Model:
    """The model of these dictionaries, its thresholds and probabilities fitted on the rows ``rest`` (y, text)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, total = Distance(toxic, ordinary), np.zeros(2 * (SPAN + len(ANCHOR)), np.int64)
        for batch in sliced(batches, 64):
            for t in texts(batch, "text"):
                total += np.bincount(distance.lengths(t), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["length", "n"])

    lengths = rest.where("y = 0").select("text").mapInArrow(measured, "length int, n long").groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").toArrow()
    upto = np.cumsum(np.array(lengths.column(1).to_pylist(), float))
    long = int(np.searchsorted(upto, PLAIN * upto[-1], "right")) if len(upto) and upto[-1] else 0

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(toxic, ordinary)
        for batch in sliced(batches, 64):
            found = [distance.excess(t, long, SAVED.start) for t in texts(batch, "text")]
            excess = pa.array([e.tolist() for _, e in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), excess], names=["y", "n", "excess"])

    found = rest.mapInArrow(counted, "y int, n long, excess array<long>").orderBy("n", "y", "excess").toArrow()
    y, n = (np.array(found.column(i).to_pylist(), int) for i in (0, 1))
    excess = np.array(found.column(2).to_pylist(), float).reshape(len(y), len(SAVED))
    weights = np.where(y == 1, 1 / share[1], 1 / share[0])
    halves = [np.arange(len(y)) % 2 == i for i in (0, 1)]

    def error(i: int) -> float:
        """Squared error of each half's rows by the calibration of the other half."""
        scores = evidence(n, excess[:, i])
        return sum(float((weights[h] * (Isotonic(scores[~h], y[~h], weights[~h], default=prior)(scores[h]) - y[h]) ** 2).sum()) for h in halves)

    best = min(range(len(SAVED)), key=error)
    return Model(toxic, ordinary, long, SAVED[best], Isotonic(evidence(n, excess[:, best]), y, weights, default=prior))


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) per row of ``df``: probability of toxicity, and 1 from ``threshold`` on.

    Whole texts are judged. Null and empty texts hold no window and get the score of no evidence. Null ids
    and repeated rows pass through, one row each. Other columns are not read. An empty table gives an empty result. Without labels
    of a class to learn from, every score is the toxic share among the labels.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a step function: under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probability = shared.value.scorer()
        for batch in sliced(batches, 128):
            p = probability(texts(batch, text_col))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")


def without_toxic(df: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df``, with all their columns, whose score is below ``threshold``; see ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge():
        probability = shared.value.scorer()
        return lambda found: probability(found) < threshold

    return filtered(df, text_col, judge)
