"""Quality scores: ridge regression on random Fourier features of text statistics, isotonically calibrated.

The features approximate a Gaussian kernel over standardised statistics of a whole text. Tasks sum their
part of the normal equations; the driver adds those few fixed-size parts and solves them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import Isotonic
from .common import agreed_labels, materialise, raw_texts, sliced

#: Labelled rows that are learned from at most, three quarters for the regression, one for calibration.
LABELLED_ROWS = 200_000
PARTS = 16  # tasks that sum normal equations
FEATURES = 384
RIDGE = 1e-3
WIDTH = 0.15  # the kernel's inverse width on standardised statistics, per statistic


def _classes() -> np.ndarray:
    """Byte value -> kind: 0 other, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 line end, 6 punctuation, 7 non-ASCII."""
    kind = np.zeros(256, np.int64)
    for b in range(128):
        c = chr(b)
        kind[b] = 5 if c == "\n" else 4 if c.isspace() else 3 if c.isdigit() else 2 if c.isupper() else 1 if c.islower() else 6 if 32 < b < 127 else 0
    kind[128:] = 7
    return kind


KIND = _classes()


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text, finite for every text."""
    n = len(text)
    if not n:
        return [0.0] * 24
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(KIND, counts, minlength=8) / n
    p = counts[counts > 0] / n
    words = text.split()
    w = max(1, len(words))
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = text.split(b"\n")
    stripped = [x[-1:] for x in words]
    return [
        np.log1p(n), np.log1p(w), *kinds[1:8],
        float(-(p * np.log(p)).sum()),
        float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())),
        len(seen) / w, seen.most_common(1)[0][1] / w if words else 0.0,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        len(set(zip(words, words[1:], strict=False))) / w,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        len(zlib.compress(text, 1)) / (n + 32),
        text.count(b"!") / w, text.count(b"|") / w,
        sum(x in b"#$%&*+=<>@^_~\\/" for x in stripped) / w,
        sum(map(bytes.isupper, words)) / w,
    ]


def statistics_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in raw_texts(batch, text_col)], pa.list_(pa.float64()))], names=[id_col, "x"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, x array<double>")


class Kernel:
    """Random Fourier features over standardised statistics."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.standard_normal((len(mean), FEATURES)) * WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


class Model:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray, calibrated: Isotonic):
        self.kernel, self.weights, self.calibrated = kernel, weights, calibrated

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.kernel(x) @ self.weights if self.kernel else np.zeros(len(x)))


def fit(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from ``labels`` (id, 0/1) and the table of statistics; at most about LABELLED_ROWS rows, taken by hash.

    Ids that are null or have both labels are not learned from.
    """
    known = agreed_labels(labels, id_col, label_col).withColumn("y", F.col("y").cast("double"))
    share = min(1.0, LABELLED_ROWS / max(1, known.count()))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(41)), F.lit(1_000_000)) / 1e6
    rows = materialise(stats.join(known.where(place < share), id_col).withColumn("fits", F.pmod(F.xxhash64(F.col(id_col), F.lit(43)), F.lit(4)) > 0).select("x", "y", "fits"))
    width = len(statistics(b""))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        n = 0
        for batch in batches:
            x = _matrix(batch.column(0), width)
            total += [x.sum(0), (x * x).sum(0)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "sums"])

    def added(df: DataFrame, function) -> tuple[int, np.ndarray]:
        parts = df.coalesce(PARTS).mapInArrow(function, "n long, sums binary").collect()
        return sum(p["n"] for p in parts), sum((np.frombuffer(p["sums"]) for p in parts), np.zeros(1))

    fitting = rows.where("fits")
    n, sums = added(fitting.select("x"), moments)
    if not n:
        return Model(None, np.zeros(0), Isotonic(np.zeros(0), np.zeros(0), default=0.5))
    mean, square = sums.reshape(2, width) / n
    kernel = Kernel(mean, np.sqrt(np.maximum(0, square - mean * mean)))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in sliced(batches, 4096):
            z = kernel(_matrix(batch.column(0), width))
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ np.asarray(batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "sums"])

    system = added(fitting.select("x", "y"), equations)[1].reshape(FEATURES + 1, FEATURES + 2)
    weights = np.linalg.solve(system[:, :-1] + RIDGE * n * np.eye(FEATURES + 1) / FEATURES, system[:, -1])
    rest = rows.where("not fits").select("x", "y").toArrow().combine_chunks()
    if not rest.num_rows:
        rest = fitting.select("x", "y").toArrow().combine_chunks()
    x = np.array(rest.column("x").to_pylist(), float)
    return Model(kernel, weights, Isotonic(kernel(x) @ weights, np.array(rest.column("y"), float)))


def score(stats: DataFrame, model: Model, *, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) per row of the table of statistics: probability of label 1, and 1 from ``threshold`` on."""
    id_type = stats.schema[id_col].dataType.simpleString()
    shared = stats.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(statistics(b""))
        for batch in sliced(batches, 4096):
            p = shared.value(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return stats.select(id_col, "x").mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")


def fit_and_score(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) per row of ``df``, learned from ``labels``.

    Null and empty texts have statistics of zero and are scored like any other. Null ids and repeated rows
    pass through, one row each. Other columns are not read. An empty table gives an empty result. Without
    labels every score is 0.5.
    """
    stats = materialise(statistics_table(df, id_col, text_col))
    return score(stats, fit(stats, labels, id_col=id_col, label_col=label_col), id_col=id_col, threshold=threshold)
