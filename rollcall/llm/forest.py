"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Every tree splits at random directions: a node's threshold and spill band come from a bounded sample of its
label's vectors, the tree's depth from the number of the label's vectors, and the number of trees from how
often pairs right at the threshold meet in a leaf, which is measured while fitting. Vectors within the band
go to both children. Vectors are routed as one row each with the list of their leaves. Leaves are compared
in full, in blocks of bounded size. A pair that meets in several leaves counts in the first one only, so
that links are counted, never listed; leaves hand on one edge per linked vector for the components.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise
from .vectors import matrices

LEAF = 2048  # vectors a leaf should hold
BLOCK = 4096  # vectors of a leaf that one task compares at once; larger leaves are compared block by block
LEAF_SAMPLE, SAMPLE = 64, 1 << 18  # vectors of a label that its trees are fitted on, by leaf and in all: about, at most
ROUTED = 1 << 16  # vectors that are routed as one group
DIRECTIONS = 1024  # of a tree
BAND = 0.05  # share of a node's vectors on either side of its threshold that spill over
MISS = 0.01  # share of pairs at the threshold that may meet in no leaf
PROBES, FEWEST, MOST = 512, 2, 64  # pairs that this is measured on; trees


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, also of those whose squares are beyond a double's range."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class Forest:
    """Directions, thresholds and bands of one label's trees; ``leaves`` routes unit vectors."""

    def __init__(self, width: int, depth: int, seed: int = 7):
        self.width, self.depth, self.seed = width, depth, seed
        self.split: list[np.ndarray] = []  # by tree and inner node (root: 1): low, threshold, high
        self.directions: list[np.ndarray] = []

    def __getstate__(self):
        return self.__dict__ | {"directions": []}

    def _directions(self, tree: int) -> np.ndarray:
        while len(self.directions) <= tree:
            self.directions.append(np.random.default_rng((self.seed, len(self.directions))).standard_normal((DIRECTIONS, self.width)).astype(np.float32))
        return self.directions[tree]

    @staticmethod
    def _direction(node):
        return (node * 2654435761) % DIRECTIONS

    def fit(self, sample: np.ndarray, least: float) -> Forest:
        """Add trees until pairs of cosine ``least`` miss one another with a probability of MISS at most."""
        sample = sample.astype(np.float32)
        x = sample[:PROBES]
        away = np.random.default_rng(self.seed).standard_normal(x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        y = least * x + (1 - least**2) ** 0.5 * unit(away)
        met = 0.0
        while len(self.split) < MOST and (len(self.split) < FEWEST or (1 - met / len(self.split)) ** len(self.split) > MISS):
            self.split.append(self._tree(len(self.split), sample))
            met += self._meeting(len(self.split) - 1, x, y)
        return self

    def _tree(self, tree: int, sample: np.ndarray) -> np.ndarray:
        directions, split = self._directions(tree), np.zeros((1 << self.depth, 3), np.float32)
        nodes = {1: np.arange(len(sample))}
        for node in range(1, 1 << self.depth):
            rows = nodes.pop(node, np.empty(0, int))
            if len(rows) < 8:
                continue
            p = sample[rows] @ directions[self._direction(np.int64(node))]
            split[node] = np.quantile(p, [0.5 - BAND, 0.5, 0.5 + BAND])
            nodes[2 * node], nodes[2 * node + 1] = rows[p < split[node, 1]], rows[p >= split[node, 1]]
        return split

    def _meeting(self, tree: int, x: np.ndarray, y: np.ndarray) -> float:
        """Share of pairs that share a leaf of the tree."""
        (a, leaf_a), (b, leaf_b) = self._routed(tree, x), self._routed(tree, y.astype(np.float32))
        known = set(zip(a.tolist(), leaf_a.tolist(), strict=True))
        return len({i for i, leaf in zip(b.tolist(), leaf_b.tolist(), strict=True) if (i, leaf) in known}) / max(1, len(x))

    def _routed(self, tree: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        directions, split = self._directions(tree), self.split[tree]
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(self.depth):
            p = np.einsum("ij,ij->i", x[row], directions[self._direction(node)])
            low, mid, high = split[node].T
            both = (p >= low) & (p <= high) & (low < high)
            over = 2 * node[both] + (p[both] < mid[both])
            node = np.concatenate([2 * node + (p >= mid), over])
            row = np.concatenate([row, row[both]])
        return row, node

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row is in, by row and leaf. A leaf's number holds its tree's above its node's."""
        x = x.astype(np.float32)
        routed = [self._routed(t, x) for t in range(len(self.split))]
        row = np.concatenate([r for r, _ in routed])
        leaf = np.concatenate([(t << 40) | n for t, (_, n) in enumerate(routed)])
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def components_of(near: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a boolean adjacency matrix."""
    label = np.full(len(near), -1)
    for start in range(len(near)):
        if label[start] < 0:
            frontier = np.array([start])
            while len(frontier):
                label[frontier] = start
                frontier = np.flatnonzero(near[frontier].any(axis=0) & (label < 0))
    return label


def compare(ids: np.ndarray, n: np.ndarray, leaves: list[np.ndarray], x: np.ndarray, side: np.ndarray | None, leaf: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links counted here, root) of every vector with a link in this group.

    ``side``: only pairs across the two sides are compared; None: all pairs. ``n``: copies each vector stands for.
    """
    m = len(ids)
    near = np.zeros((m, m), bool)
    for a in range(0, m, 512):
        near[a : a + 512] = x[a : a + 512] @ x.T >= least
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    near |= near.T
    linked = np.flatnonzero(near.any(axis=1))
    if not len(linked):
        return ids[:0], n[:0], ids[:0]
    near = near[np.ix_(linked, linked)]
    root = ids[linked][components_of(near)]
    # pairs that share an earlier leaf were counted there
    earlier = [leaves[i][leaves[i] < leaf] for i in linked]
    flat = np.concatenate(earlier)
    if len(flat):
        values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        column = np.cumsum(counts > 1) - 1
        row = np.repeat(np.arange(len(linked)), [len(e) for e in earlier])
        shared = counts[inverse] > 1
        member = np.zeros((len(linked), int((counts > 1).sum())), np.float32)
        member[row[shared], column[inverse[shared]]] = 1
        for a in range(0, len(linked), 512):
            near[a : a + 512] &= member[a : a + 512] @ member.T == 0
    links = [near[a : a + 512].astype(np.float64) @ n[linked] for a in range(0, len(linked), 512)]
    return ids[linked], np.concatenate(links), root


def usable(vector, label):
    """Label present and vector present, non-zero, of finite components only."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return label.isNotNull() & F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def link(df: DataFrame, *, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``.

    Rows link if their labels are equal and their cosine in double precision is at least ``least``; pairs
    must meet in a leaf to be found. Vectors that are null, empty, zero or hold null or non-finite
    components, rows with a null label or id, and vectors of different lengths link with nothing. Equal
    vectors of a label form a class that takes part once and counts as often as it has rows, so repeated
    rows link with one another. Classes named by the same smallest id, where an id has several vectors, are
    one vertex. ``kept``: the id is its component's smallest (true for a null id). Other
    columns are not read. An empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    v, label = F.col(vector_col), F.col(label_col)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.when(usable(v, label) & F.col(id_col).isNotNull(), label).alias("label"), v.alias("v"), F.xxhash64(v).alias("h1"), F.hash(v).alias("h2")
    )
    classes = rows.where("label is not null").groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = materialise(classes.withColumn("width", F.size("v")))
    group = ["label", "width"]
    sizes = classes.groupBy(*group).agg(F.count("*").alias("size"))
    # the largest sample that leaves of LEAF_SAMPLE vectors fill bounds the depth
    most = (SAMPLE // LEAF_SAMPLE).bit_length() - 1
    sizes = sizes.withColumn("depth", F.least(F.lit(most), F.ceil(F.log2(F.col("size") / LEAF)).cast("int")))
    split = materialise(sizes.where("depth > 0").withColumn("groups", F.ceil(F.col("size") / ROUTED).cast("int")))
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    keys = f"label {kinds['label']}, width int"

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.array(pdf["v"].tolist(), np.float64))
        forest = Forest(x.shape[1], int(pdf["depth"].iloc[0])).fit(x, least)
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "width": pdf["width"].iloc[:1], "forest": [pickle.dumps(forest)]})

    share = F.least(F.lit(1.0), LEAF_SAMPLE * F.pow(F.lit(2.0), "depth") / F.col("size"))
    sample = classes.join(split, group).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select(*group, "depth", "v")
    forests = materialise(sample.groupBy(*group).applyInPandas(fitted, f"{keys}, forest binary"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = None
        for batch in batches:
            # every group starts with its forest's row
            starts = np.flatnonzero(np.asarray(batch.column(3)) == 0).tolist()
            for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if part.num_rows and part.column(3)[0].as_py() == 0:
                    forest = pickle.loads(part.column(7)[0].as_py())
                    part = part.slice(1)
                for _, m in matrices(part, 6):
                    row, leaf = forest.leaves(unit(m))
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(m)))])
                    leaves = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(leaf, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 1, 4, 5, 6)), leaves], names=["label", "width", "id", "n", "v", "leaves"])

    blank = {"id": "long", "n": "long", "v": kinds["v"]}
    heads = forests.join(split, group).select(*group, F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("role"), *(F.lit(None).cast(t).alias(c) for c, t in blank.items()), "forest")
    bodies = classes.join(split, group).select(*group, F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("role"), "id", "n", "v", F.lit(None).cast("binary").alias("forest"))
    order = [*group, "part"]
    routed = heads.union(bodies).repartition(*order).sortWithinPartitions(*order, "role").mapInArrow(route, f"{keys}, id long, n long, v {kinds['v']}, leaves array<long>")
    whole = classes.join(split, group, "left_anti").select(*group, "id", "n", "v", F.array(F.lit(0).cast("long")).alias("leaves"))
    routed = materialise(routed.union(whole))

    members = routed.withColumn("leaf", F.explode("leaves"))
    crowded = members.groupBy(*group, "leaf").count().where(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = (
        members.join(crowded, [*group, "leaf"], "left")
        .withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(*group, "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "v", "leaves")
    )

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.array(pdf["v"].tolist(), np.float64))
        side = pdf["own"].to_numpy() if pdf["i"].iloc[0] != pdf["j"].iloc[0] else None
        ids, links, root = compare(pdf["id"].to_numpy(), pdf["n"].to_numpy(np.float64), pdf["leaves"].tolist(), x, side, int(pdf["leaf"].iloc[0]), least)
        return pd.DataFrame({"id": ids, "links": links.astype(np.int64), "root": root})

    found = materialise(dealt.groupBy(*group, "leaf", "i", "j").applyInPandas(compared, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found, found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    result = classes.join(links, "id", "left").join(component, "id", "left").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.drop("v").join(result, ["label", "h1", "h2"], "left")
    component_id = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").cast(id_type).alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept")
    )
