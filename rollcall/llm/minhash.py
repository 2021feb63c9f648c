"""MinHash near-duplicate detection with odd sketches.

One scan hashes each whole text's word shingles into a set, takes MinHash samples of it, keys for bands of
samples, and the samples' odd sketch: a bitmap in which every (position, sample) pair flips one bit, so
that the population count of two sketches' XOR tells how many samples differ, most precisely for similar
sets. Equal sets form one class. Classes that share a band key lie in one bucket and are candidates;
sketches weed them out; what is left is confirmed on the full sets, exactly.

Each bucket is first compared with its hub, the member whose buckets are largest in sum: of a text and
its near copies that is the text itself, so a group of m costs about m comparisons. Only where the rest
of a bucket then lies in several components are its members compared with one another, in blocks, by
sketch first; blocks hand on members and the edges of a spanning forest, never pairs, so no step makes
more rows than there are members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, connected_components, materialise, raw_texts, sliced, tidied

BANDS, BAND_ROWS = 52, 8  # a pair of similarity 0.8 shares no band with a probability below 1e-4
SAMPLES = 1024  # in the sketch; the first BANDS * BAND_ROWS of them make the band keys
SKETCH_WORDS = 32  # 64 bits each
BLOCK = 2048  # members of a bucket that are compared at once; larger buckets are compared block by block
BLOCK_SHINGLES = 1 << 21  # that the sets of a block have about, at most
LEAVES = 4096  # members that are compared with one hub in one group of rows

# Odd multipliers of the 64-bit mixing steps (golden ratio and two of SplitMix64's).
MIX, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's ``width``-word shingles."""

    def __init__(self, width: int):
        self.width = width
        self.word = BoundedCache(xxhash.xxh3_64_intdigest, limit=100_000)  # hashing a rare word again costs little

    def shingles(self, text: bytes) -> np.ndarray:
        """Words are runs of bytes other than ASCII white space, A-Z lower-cased. Fewer than ``width``: one shingle of all."""
        words = text.lower().split()  # of bytes: exactly A-Z, and exactly 0x20 and 0x09-0x0D
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.word.__getitem__, words), np.uint64, n)
        width = min(n, self.width)
        h = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            h = h * MIX + w[i : n - width + 1 + i]
        return np.unique(mixed(h))


def digest(shingles: np.ndarray) -> np.ndarray:
    """128 bits of a set, as two signed integers."""
    return np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b| for two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


class Sampler:
    """MinHash samples, band keys and odd sketches of shingle sets."""

    STEP = 256

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, SAMPLES, np.uint32)[:, None] | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, SAMPLES, np.uint32)[:, None]
        self.position = np.arange(SAMPLES, dtype=np.uint64) * MIX
        self.held = np.empty((SAMPLES, self.STEP), np.uint32)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
        out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
        for at in range(0, x.shape[1], self.STEP):
            part = x[:, at : at + self.STEP]
            h = np.multiply(self.a, part, out=self.held[:, : part.shape[1]])
            h += self.b
            np.minimum(out, h.min(axis=1), out=out)
        return out

    def bands(self, samples: np.ndarray) -> np.ndarray:
        s = samples[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
        h = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(BAND_ROWS):
            h = mixed(h * MIX + s[:, i])
        return h.view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        bits = 64 * SKETCH_WORDS
        bit = (mixed(samples.astype(np.uint64) + self.position) % np.uint64(bits)).astype(np.int64)
        odd = (np.bincount(bit, minlength=bits) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.int64)


def most_odd_bits(least: float, deviations: float = 4.0) -> int:
    """Odd bits up to which a pair of similarity ``least`` stays, with that many standard deviations to spare.

    Two sources of chance add up: how many samples differ, and how their bits fall together.
    """
    b, flips = 64 * SKETCH_WORDS, 2 * SAMPLES * (1 - least)
    slope = (1 - 2 / b) ** flips
    by_samples = slope**2 * 4 * SAMPLES * least * (1 - least)
    by_bits = b / 4 * (1 - slope**2) + b * (b - 1) / 4 * ((1 - 4 / b) ** flips - slope**2)
    return int(b / 2 * (1 - slope) + deviations * (by_samples + max(0.0, by_bits)) ** 0.5)


def signatures(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t, n, h1, h2, bands, sketch): text's hash, and size, 128-bit digest, band keys and sketch of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler = Shingler(width), Sampler()
        for batch in sliced(batches, 256):
            n, digests, bands, sketch = [], [], [], []
            for text in raw_texts(batch, text_col):
                s = shingler.shingles(text)
                n.append(len(s))
                if len(s):
                    samples = sampler.samples(s)
                    digests.append(digest(s))
                    bands.append(sampler.bands(samples))
                    sketch.append(sampler.sketch(samples))
                else:
                    digests.append(np.zeros(2, np.int64))
                    bands.append(np.zeros(0, np.int64))
                    sketch.append(np.zeros(0, np.int64))
            h = np.array(digests)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(bands, longs), pa.array(sketch, longs)],
                names=["id", "t", "n", "h1", "h2", "bands", "sketch"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), text_col)
    return rows.mapInArrow(run, "id long, t long, n long, h1 long, h2 long, bands array<long>, sketch array<long>")


def by_groups(rows: DataFrame, keys: list[str], order: list[str], each: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows dealt by ``keys`` and streamed in ``order``; ``each()`` makes a task's function over its batches."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: each()(tidied(batches)), schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The groups of equal first ``keys`` columns in a sorted stream, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tags = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1).tolist(), len(tags)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and last != tuple(tags[a]):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(tags[a])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [np.asarray(batch.column(batch.schema.get_field_index(name))) for name in names]


def table_of(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)).flatten()).reshape(-1, width)


def candidates(key: int, own: np.ndarray, c: np.ndarray, n: np.ndarray, across: bool, bands: np.ndarray, bits: np.ndarray, percent: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions a < b) of one group whose sketches leave a link possible.

    Only members of different components meet; across two blocks only members of different ones; and only
    in the first bucket that both share, so that a pair is looked at once.
    """
    m = len(c)
    step = max(1, (1 << 16) // m)
    place = np.arange(m)
    for at in range(0, m, step):
        part = slice(at, at + step)
        wanted = (c[part, None] != c[None, :]) & (place[part, None] < place[None, :])
        wanted &= 100 * np.minimum(n[part, None], n[None, :]) >= percent * np.maximum(n[part, None], n[None, :])
        if across:
            wanted &= own[part, None] != own[None, :]
        a, b = np.nonzero(wanted)
        a += at
        near = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= most
        a, b = a[near], b[near]
        if len(a):
            shared = (bands[a] == bands[b]).argmax(axis=1)
            first = bands[a, shared] == key
            yield a[first], b[first]


def survivors(dealt: DataFrame, percent: int) -> DataFrame:
    """The rows of groups (key, i, j) that have a candidate there: (key, i, j, own, v, c)."""
    most = most_odd_bits(percent / 100)

    def each():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in whole_groups(batches, 3):
                if group.num_rows < 2:
                    continue
                key, i, j, own, c, n = numbers(group, ["key", "i", "j", "own", "c", "n"])
                bits = table_of(group, "sketch", SKETCH_WORDS).view(np.uint64)
                stays = np.zeros(len(c), bool)
                for a, b in candidates(key[0], own, c, n, i[0] != j[0], table_of(group, "bands", BANDS), bits, percent, most):
                    stays[a] = stays[b] = True
                if stays.any():
                    yield group.select(["key", "i", "j", "own", "v", "c"]).filter(pa.array(stays))

        return run

    return by_groups(dealt, ["key", "i", "j"], ["v"], each, "key long, i int, j int, own int, v long, c long")


def spanning_links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(src, dst): a spanning forest, over components, of the links inside each group (key, i, j), confirmed on full sets."""
    most = most_odd_bits(percent / 100)

    def each():
        shingler, sampler = Shingler(width), Sampler()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in whole_groups(batches, 3):
                key, i, j, own, c, v, h1, h2 = numbers(group, ["key", "i", "j", "own", "c", "v", "h1", "h2"])
                sets = [shingler.shingles(t) for t in raw_texts(group, "text")]
                right = [k for k, s in enumerate(sets) if tuple(digest(s)) == (h1[k], h2[k])]
                if len(right) < 2:
                    continue
                sets, own, c, v = [sets[k] for k in right], own[right], c[right], v[right]
                samples = [sampler.samples(s) for s in sets]
                bands, bits = np.array([sampler.bands(s) for s in samples]), np.array([sampler.sketch(s) for s in samples]).view(np.uint64)
                parent = {x: x for x in c.tolist()}

                def root(x: int, parent=parent) -> int:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                src, dst = [], []
                n = np.array([len(s) for s in sets])
                for found in candidates(key[0], own, c, n, i[0] != j[0], bands, bits, percent, most):
                    for a, b in zip(*(x.tolist() for x in found), strict=True):
                        p, q = root(int(c[a])), root(int(c[b]))
                        if p != q and linked(sets[a], sets[b], percent):
                            parent[q] = p
                            src.append(int(v[a]))
                            dst.append(int(v[b]))
                if src:
                    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        return run

    return by_groups(rows, ["key", "i", "j"], ["v"], each, "src long, dst long")


def links_with_hubs(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(src, dst) of the rows (src, salt, role, v, h1, h2, text) that link with their hub, the row of role 0 of (src, salt)."""

    def each():
        shingler = Shingler(width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = hub = None
            for batch in sliced(batches, 256):
                src, dst = [], []
                columns = [x.tolist() for x in numbers(batch, ["src", "salt", "role", "v", "h1", "h2"])]
                for s, salt, role, v, h1, h2, text in zip(*columns, raw_texts(batch, "text"), strict=True):
                    own = shingler.shingles(text)
                    if tuple(digest(own)) != (h1, h2):
                        continue  # another text under the same id
                    if (s, salt) != at:
                        at, hub = (s, salt), None
                    if role == 0:
                        hub = own
                    elif hub is not None and linked(hub, own, percent):
                        src.append(s)
                        dst.append(v)
                if src:
                    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        return run

    return by_groups(rows, ["src", "salt"], ["role"], each, "src long, dst long")


def assigned(df: DataFrame, *, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t, n, c, component_id) per row of ``df``: c names the component of rows that share a set or link, null for rows that do neither."""
    sig = materialise(signatures(df, width, id_col, text_col))
    grouped = sig.where("n > 0 and id is not null").groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    # equal sets have equal bands and sketches; the number is fixed once the table is written
    classes = materialise(grouped.withColumn("v", F.monotonically_increasing_id()))

    keyed = classes.select("v", F.explode("bands").alias("key"))
    buckets = materialise(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"))
    crowd = buckets.groupBy("v").agg(F.sum("m").alias("crowd"))
    hubs = buckets.join(crowd, "v").groupBy("key").agg(F.max(F.struct("crowd", -F.col("v"))).alias("top")).select("key", (-F.col("top.col2")).alias("hub"))
    followers = materialise(buckets.join(hubs, "key").where("v <> hub").select("key", "hub", "v"))

    pairs = followers.select(F.col("hub").alias("src"), F.col("v").alias("dst")).distinct()
    ends = [classes.select(F.col("v").alias(end), F.col("n").alias(f"{end}_n"), F.col("sketch").alias(f"{end}_sketch")) for end in ("src", "dst")]
    odd = F.aggregate(F.zip_with("src_sketch", "dst_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, x: total + x)
    sizes_allow = 100 * F.least("src_n", "dst_n") >= percent * F.greatest("src_n", "dst_n")
    weeded = materialise(pairs.join(ends[1], "dst").join(ends[0], "src").where(sizes_allow & (odd <= most_odd_bits(percent / 100))).select("src", "dst"))

    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    named = classes.select("v", "rep", "h1", "h2")
    salts = weeded.groupBy("src").agg(F.ceil(F.count("*") / LEAVES).cast("int").alias("salts"))
    leaf = weeded.join(salts, "src").select("src", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("dst").alias("v"))
    hub = salts.select("src", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("src").alias("v"))
    parts = texts.join(leaf.union(hub).join(named, "v"), "rep").select("src", "salt", "role", "v", "h1", "h2", "text")
    edges = materialise(links_with_hubs(parts, width, percent))

    def components(edges: DataFrame) -> DataFrame:
        return connected_components(edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))), edges)

    component = materialise(components(edges))
    vertices = classes.select("v", "n").join(component.select(F.col("id").alias("v"), "component"), "v", "left").select("v", "n", F.coalesce("component", "v").alias("c"))
    labelled = materialise(followers.select("key", "v").join(vertices, "v"))
    several = labelled.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
    several = several.select("key", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = labelled.join(several, "key").withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(classes.select("v", "bands", "sketch"), "v")
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "c", "n", "bands", "sketch")
    staying = materialise(survivors(dealt, percent))
    if not staying.isEmpty():
        parts = texts.join(staying.join(named, "v"), "rep").select("key", "i", "j", "own", "c", "v", "h1", "h2", "text")
        later = spanning_links(parts, width, percent)
        edges = materialise(component.select(F.col("component").alias("src"), F.col("id").alias("dst")).union(later))
        component = materialise(components(edges))

    c = component.select(F.col("id").alias("v"), F.col("component").alias("c"))
    names = classes.select("v", "rep").join(c, "v").groupBy("c").agg(F.min("rep").alias("name"))
    known = classes.select("v", "h1", "h2", "rep", "copies").join(c.join(names, "c"), "v", "left").where("copies > 1 or c is not null")
    known = known.select("h1", "h2", F.coalesce("c", "v").alias("c"), F.coalesce("name", "rep").alias("name"))
    in_class = (F.col("n") > 0) & F.col("id").isNotNull()
    rows = sig.select("id", "t", "n", F.when(in_class, F.col("h1")).alias("h1"), "h2").join(known, ["h1", "h2"], "left")
    return rows.select("id", "t", "n", "c", F.coalesce("name", "id").alias("component_id"))


def near_duplicates(df: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``.

    Rows link if 100 * |A & B| >= percent * |A | B| for their shingle sets; a component is what links
    reach, named by its smallest id; ``kept`` marks that row. Null, empty and blank texts have no shingles
    and link with nothing. Equal rows share a component. Rows of one id with different texts are judged
    each by its own text. Rows with a null id link with nothing, have no component and are kept. Other
    columns are not read. An empty table gives an empty result.
    """
    rows = assigned(df, width=width, percent=percent, id_col=id_col, text_col=text_col)
    id_type = df.schema[id_col].dataType.simpleString()
    return rows.select(
        F.col("id").cast(id_type).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(id_type).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def without_copies(df: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, but for one row of each component of ``near_duplicates``.

    That row has the component's smallest id and, if several texts of the component have it, the smallest
    hash of its text. Of rows equal in id and text one stays, whatever their other columns hold; rows
    without shingles are no copies of anything else. Rows with a null id all stay.
    """
    rows = materialise(assigned(df, width=width, percent=percent, id_col=id_col, text_col=text_col).where("c is not null").select("c", "id", "t", "component_id"))
    least = rows.where("id = component_id").groupBy("c").agg(F.min("t").alias("kept"))
    named = rows.where("id = component_id").join(least, "c").where("t <> kept").select("id", "t")
    dropped = rows.where("id <> component_id").select("id", "t").union(named).distinct()
    own, hashed = "_id", "_hash"
    while own in df.columns or hashed in df.columns:
        own, hashed = f"_{own}", f"_{hashed}"
    docs = df.where(F.col(id_col).isNotNull()).withColumn(own, F.col(id_col).cast("long")).withColumn(hashed, F.xxhash64(text_col))
    # the join leaves equal rows together, so that finding them takes no further shuffle
    kept = docs.join(dropped.toDF(own, hashed), [own, hashed], "left_anti")
    return kept.dropDuplicates([own, hashed]).select(df.columns).union(df.where(F.col(id_col).isNull()))
