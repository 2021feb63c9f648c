"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Each language has one model of the characters of its words, a word being a run of letters between a start
and an end mark. An order's n-grams lie in one sorted array of 64-bit hashes beside their discounted
probabilities, its contexts in another beside their interpolation weights. The language of a text is the one
of the lowest cross-entropy per character. Words are scored once per worker and remembered.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, materialise, sliced, texts

#: Rows of each language that its model is learned from at most (about), and as many again a quarter to calibrate.
ROWS_PER_LANGUAGE = 1500
ORDER = 5
#: Bytes of text that all models together are learned from at most (about), dealt evenly to the languages. Bounds what
#: the driver collects and what is broadcast: an n-gram takes 12 bytes, and text has at most one of an order by byte.
LEARNED_BYTES = 12 << 20
BLOCK_WORDS = 100  # that are learned from together or not at all
LONG = 64  # letters of a word from which it is not remembered
START, END = 1, 2
UNKNOWN = "und"
CHANCE = 4.0  # deviations by which chance may lift a text's entropy
COMMON, MARGIN, LEAST = 0.99, 2.0, 1.0  # quantile of the calibration rows' excess beyond chance; the limit in its multiples; bits a symbol at least

# Odd multipliers of the 64-bit mixing steps (golden ratio and one of SplitMix64's).
MIX, MIX_A = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _letters() -> str:
    """A character class of letters with their marks, and numerals that are no digits."""
    inside = [chr(i).isalnum() and not chr(i).isdecimal() or unicodedata.category(chr(i))[0] == "M" for i in range(sys.maxunicode + 1)]
    edges = [i for i in range(len(inside)) if inside[i] != (i > 0 and inside[i - 1])] + [len(inside)] * inside[-1]
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edges[::2], edges[1::2], strict=True)) + "]"


_runs = re.compile(_letters() + "+").findall


def words_of(text: str) -> list[str]:
    """The text's words, lower-cased; none if it has no letter."""
    words = _runs(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def positions(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For every predicted symbol of every word: hashes of the n-grams that end there and of their contexts.

    Lists by n - 1; an n-gram that would reach over the word's start has hash 0. Third: the word of each symbol.
    """
    flat = np.frombuffer("".join(["\x01" + w + "\x02" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(inside > 0)
    grams, contexts = [], []
    context = np.full(len(at), 7, np.uint64)
    for n in range(1, ORDER + 1):
        if n > 1:
            # one symbol further back; the hash runs from near to far, so that contexts grow by one step
            back = at - n + 1
            fits = inside[at] >= n - 1
            context = np.where(fits & (context > 0), _step(context, flat[np.maximum(0, back)]), np.uint64(0))
        grams.append(np.where(context > 0, _step(context ^ MIX_A, flat[at]), np.uint64(0)))
        contexts.append(context)
    return grams, contexts, word[at]


def _step(h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    h = (h ^ symbol) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX_A
    return (h ^ (h >> np.uint64(32))) | np.uint64(1)


class LanguageModel:
    """Interpolated Kneser-Ney estimates of one language."""

    def __init__(self, words: list[str], counts: np.ndarray):
        grams, contexts, word = positions(words)
        flat_symbols = max(1, len({c for w in words for c in w}) + 1)
        self.floor = 1.0 / (flat_symbols + 1)  # of any symbol, unseen ones included
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(ORDER):
            g, c, weight = grams[n], contexts[n], counts[word].astype(float)
            use = g > 0
            if n < ORDER - 1:
                # how many different symbols stand before the n-gram; at a word's start nothing does, its count is used
                longer = grams[n + 1]
                first = np.zeros(len(g), bool)
                extended = np.flatnonzero(longer > 0)
                first[extended[np.unique(longer[extended], return_index=True)[1]]] = True
                weight = np.where(longer > 0, first, weight)
            keys, at, inverse = np.unique(g[use], return_index=True, return_inverse=True)
            count = np.bincount(inverse, weight[use], len(keys))
            context = c[use][at]
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones else 0.5
            c_keys, c_of = np.unique(context, return_inverse=True)
            total = np.bincount(c_of, count, len(c_keys))
            value = np.maximum(count - discount, 0) / np.maximum(total[c_of], 1e-12)
            rest = np.clip(1 - np.bincount(c_of, value, len(c_keys)), 1e-6, 1)
            self.grams.append((keys, value.astype(np.float32)))
            self.contexts.append((c_keys, rest.astype(np.float32)))

    def log2(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log probability, base 2, of each symbol."""
        p = np.full(len(grams[0]), self.floor)
        for n in range(ORDER):
            rest, known = find(self.contexts[n], contexts[n])
            value, hit = find(self.grams[n], grams[n])
            p = np.where(known, np.where(hit, value, 0) + rest * p, p)
        return np.log2(np.maximum(p, 1e-12))


def find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of hashes in a sorted array, and whether they are there."""
    keys, values = table
    if not len(keys):
        return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return values[at], (keys[at] == hashes) & (hashes > 0)


class Identifier:
    """The languages' models with their calibration."""

    def __init__(self, languages: list[str], models: list[LanguageModel]):
        self.languages, self.models = languages, models
        self.sharpness = 1.0
        self.usual = np.zeros((len(languages), 3))  # usual bits a symbol; variance allowed of the text's mean: by chance, divided by its length; of texts

    def score_words(self, words: list[str]) -> np.ndarray:
        """Summed log2 probabilities by language, the last column the number of symbols."""
        grams, contexts, word = positions(words)
        out = np.empty((len(words), len(self.models) + 1))
        for i, model in enumerate(self.models):
            out[:, i] = np.bincount(word, model.log2(grams, contexts), len(words))
        out[:, -1] = np.bincount(word, minlength=len(words))
        return out


class Scorer:
    """Sums of whole texts; remembers the words it has scored, up to ``limit``."""

    def __init__(self, identifier: Identifier, limit: int = 400_000):
        self.identifier, self.limit = identifier, limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((1 << 12, len(self.identifier.models) + 1))

    def sums(self, found: list[str]) -> np.ndarray:
        """One row per text: log2 probabilities by language and the number of symbols, 0 without a letter."""
        split = [words_of(t) for t in found]
        if len(self.known) > self.limit:
            self._forget()
        new = list({w for words in split for w in words if w not in self.known and len(w) < LONG})
        if new:
            old, now = len(self.known), len(self.known) + len(new)
            if now > len(self.table):
                self.table = np.concatenate([self.table[:old], np.empty((2 * now - old, self.table.shape[1]))])
            self.known.update(zip(new, range(old, now), strict=True))
            self.table[old:now] = self.identifier.score_words(new)
        out = np.zeros((len(found), self.table.shape[1]))
        for i, words in enumerate(split):
            at = [k for k in map(self.known.get, words) if k is not None]
            out[i] = self.table[at].sum(axis=0)
            if len(at) < len(words):
                out[i] += self.identifier.score_words([w for w in words if len(w) >= LONG]).sum(axis=0)
        return out


def decide(identifier: Identifier, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language's index or -1, probability, whether the text is unlike every language learned)."""
    n = np.maximum(sums[:, -1], 1)
    if not identifier.languages:
        return np.full(len(sums), -1), np.zeros(len(sums)), np.ones(len(sums), bool)
    logits = identifier.sharpness * sums[:, :-1] / np.sqrt(n)[:, None]
    best = logits.argmax(axis=1)
    p = 1 / np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1)
    usual, chance, between = identifier.usual[best].T
    entropy = -sums[np.arange(len(sums)), best] / n
    strange = entropy - usual > np.sqrt(between + chance / n)
    none = sums[:, -1] == 0
    return np.where(none, -1, best), np.where(none, 0.0, p), strange | none


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier:
    """Learn from the texts and languages of ``df``; rows of each language taken by hash of the id, about ROWS_PER_LANGUAGE.

    Of these, blocks of words are taken by hash, up to about LEARNED_BYTES of all languages. Rows without a
    language or text, and with a null id, teach nothing.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(totals)
    if not languages:
        return Identifier([], [])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, 1.25 * ROWS_PER_LANGUAGE / totals[lang])])
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) / 1e6
    chosen = materialise(rows.where(place < share[F.col("lang")]).withColumn("fits", F.pmod(F.xxhash64("id", F.lit(23)), F.lit(5)) > 0))

    sizes = {r["lang"]: r["bytes"] for r in chosen.where("fits").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    parts = {lang: min(1.0, LEARNED_BYTES / len(sizes) / max(1, n)) * (1 << 32) for lang, n in sizes.items()}

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                words, mine = words_of(text), seen.setdefault(lang, Counter())
                for at in range(0, len(words), BLOCK_WORDS):
                    block = words[at : at + BLOCK_WORDS]
                    if zlib.crc32(" ".join(block).encode()) < parts[lang]:
                        mine.update(block)
            flat = [(lang, w, n) for lang, words in seen.items() for w, n in words.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "w", "n"])

    counts = chosen.where("fits").select("lang", "text").mapInArrow(listed, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")).orderBy("lang", "w").toArrow()
    by = np.array(counts.column("lang").to_pylist())
    all_words, n = np.array(counts.column("w").to_pylist(), object), np.array(counts.column("n").to_pylist(), np.int64)
    languages = [lang for lang in languages if (by == lang).any()]
    identifier = Identifier(languages, [LanguageModel(all_words[by == lang].tolist(), n[by == lang]) for lang in languages])
    _calibrate(identifier, chosen)
    return identifier


def _calibrate(identifier: Identifier, chosen: DataFrame) -> None:
    """Sharpness of the probabilities and each language's usual entropy, from rows that no model was learned from."""
    shared = chosen.sparkSession.sparkContext.broadcast(identifier)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches, 512):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(scorer.sums(texts(batch, "text"))), pa.list_(pa.float64()))], names=["lang", "sums"])

    rest = chosen.where("not fits").select("lang", "text").mapInArrow(summed, "lang string, sums array<double>").toArrow()
    index = {lang: i for i, lang in enumerate(identifier.languages)}
    truth = np.array([index.get(x, -1) for x in rest.column(0).to_pylist()], int)
    sums = np.array(rest.column(1).to_pylist(), float).reshape(-1, len(index) + 1)
    use = (truth >= 0) & (sums[:, -1] > 0)
    truth, sums = truth[use], sums[use]
    n = sums[:, -1]
    logits = sums[:, :-1] / np.sqrt(n)[:, None]
    logits -= logits.max(axis=1, keepdims=True)

    def loss(k: float) -> float:
        z = k * logits
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).sum())

    if len(truth):
        identifier.sharpness = min((0.05 * 1.5**i for i in range(14)), key=loss)
    for i in range(len(index)):
        mine = truth == i
        entropy = -sums[mine, i] / n[mine]
        if len(entropy) < 8:
            identifier.usual[i] = 0, 0, np.inf  # too few to tell: nothing is rejected
            continue
        usual = np.median(entropy)
        excess = entropy - usual
        chance = (CHANCE * 1.4826 * np.median(np.abs(excess) * np.sqrt(n[mine]))) ** 2  # from the median deviation
        # texts differ by more than chance, whatever their length; a quantile, so that no single odd text sets the limit
        between = np.quantile(np.maximum(0, np.maximum(0, excess) ** 2 - chance / n[mine]), COMMON)
        identifier.usual[i] = usual, chance, max(LEAST, MARGIN * between**0.5) ** 2


def identify(df: DataFrame, identifier: Identifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) per row of ``df``.

    ``lang_pred`` is a learned language, or ``und`` with score 0 for texts that are null or hold no letter
    (and for all, if no language was learned). Ties go to the alphabetically first language. ``rejected``
    also marks texts whose cross-entropy is far beyond what their best language's texts of such a length have,
    if at least 8 of these were there to calibrate. Null ids and
    repeated rows pass through, one row each; other columns are not read; an empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(identifier)  # bounded by LEARNED_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = [*shared.value.languages, UNKNOWN]
        for batch in sliced(batches, 128):
            best, p, rejected = decide(shared.value, scorer.sums(texts(batch, text_col)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in best]), pa.array(p, pa.float64()), pa.array(rejected)], names=[id_col, "lang_pred", "score", "rejected"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double, rejected boolean")


def without_rejected(df: DataFrame, identifier: Identifier, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, that ``identify`` does not reject."""
    shared = df.sparkSession.sparkContext.broadcast(identifier)

    def judge():
        scorer = Scorer(shared.value)
        return lambda found: ~decide(shared.value, scorer.sums(found))[2]

    return filtered(df, text_col, judge)
