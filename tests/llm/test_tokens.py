"""Token counts, BPE and packing against the public libraries, on odd texts and on the documents table."""

import hashlib
import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from rollcall.llm import bpe, common, packing, token_count
from rollcall.llm.tokens import read_ranks, vocabulary_path, word_vocabulary

DOCS = "/root/testdata/sf0.001/documents.parquet"
WORDS, BYTES = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "\n\n", "a", "Hello  World\n\n  x \n", "it's I'LL don't", "<|endoftext|>x<|startoftext|>", "ΟΔΥΣΣΕΥΣ Σ", "İstanbul ǅ", "été", "日本語テキスト 한국어", "👩‍👩‍👧 🎉", "x\x1cy\x1fz",
    " a b　c", "1234567890 ½ Ⅷ", "!!!???...", "a" * 5000, "ab" * 3000, " " * 700, "=" * 999 + "x", "'s't're", "tab\tend\t", "line\r\nline", "a\n b", "\n \nb", "trailing ",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, number int")


REPEATED = [(None, "a null id"), (7, "twice the same"), (7, "twice the same"), (7, "another text"), (None, None)]


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in REPEATED], "doc_id bigint, text string, n_tokens int")
    key = lambda rows: sorted((str(r.doc_id) for r in rows))
    for got in (token_count.count_tokens(df, WORDS).collect(), bpe.encode_decode(df, BYTES, public_tokenizers.PATTERN).collect(), packing.pack(df, WORDS).collect()):
        assert key(got) == ["7", "7", "7", "None", "None"]
    assert sorted(r.doc_tokens for r in packing.pack(df, WORDS).collect())[0] == 1


@pytest.fixture(scope="module")
def documents(spark):
    return [r.text for r in spark.read.parquet(DOCS).select("text").collect()]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    alphabet = "aaabcde  \n'st.,!0129éßñ日 \t"
    return ["".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(n)]


def test_counts(spark, documents):
    texts = ODD + documents + fuzz(200)
    library = Tokenizer.from_file(WORDS)
    expected = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = sorted(token_count.count_tokens(frame(spark, texts), WORDS, limit=50).collect())
    assert [(r.n_tokens, r.n_bytes, r.over_limit) for r in rows] == [(n, len((t or "").encode()), n > 50) for n, t in zip(expected, texts, strict=True)]


def test_merges_against_plain_bpe():
    v = word_vocabulary(WORDS)

    def plain(symbols):
        symbols = list(symbols)
        while ranked := [(v.merges[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in v.merges]:
            _, i = min(ranked)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return len(symbols)

    for word in ["a", "hello", "aaaaaaaaaaaaaaaa", "naïveté", "thingingthingly", "zzxqj" * 9]:
        s = v.symbols(word)
        assert len(s) - token_count.merges_done(s, v.merges) == plain(s)


def test_tree_encoding(spark, documents):
    texts = ODD + documents + fuzz(200)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(BYTES), special_tokens={})
    rows = sorted(bpe.encode_decode(frame(spark, texts), BYTES, public_tokenizers.PATTERN, keep_ids=True).collect())
    for t, r in zip(texts, rows, strict=True):
        ids = library.encode_ordinary(t or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_the_tree_encodes_the_pieces_of_the_table(documents):
    codec = bpe.TreeCodec(read_ranks(BYTES), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(BYTES), special_tokens={})
    pieces = {p for t in documents if t for p in codec.pieces(t)}
    composed = 0
    for p in pieces:
        before = codec.joins
        ids = codec.piece(p.encode())
        assert ids == library.encode_ordinary(p)
        assert (codec.joins == before) == (p.encode() in codec.ranks)
        composed += codec.joins > before
    assert composed > len(pieces) / 2 and public_tokenizers.PATTERN == bpe.WORD_PATTERN


def test_joins_of_every_cut():
    codec = bpe.TreeCodec(read_ranks(BYTES), public_tokenizers.PATTERN)
    for data in [b" international", b"aaaaaaaaaaaaaaaaaaaaaaaa", "naïveté".encode(), b"thingthingthing"]:
        whole = bpe.greedy(data, codec.ranks)
        for cut in range(len(data) + 1):
            assert codec.join(bpe.greedy(data[:cut], codec.ranks), bpe.greedy(data[cut:], codec.ranks)) == whole


@pytest.mark.parametrize("window", [16, 4096])
def test_packing(spark, documents, window):
    texts = ODD + documents
    library = Tokenizer.from_file(WORDS)
    ids = [np.array(e.ids + [2], "<u4") for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = packing.pack(frame(spark, texts).coalesce(1), WORDS, window=window, keep_ids=True).collect()
    seen = {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and 0 < r.length <= window
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == piece.tolist() and r.ids_crc32 == zlib.crc32(piece.tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, x in enumerate(ids):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == len(x)
    fills = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= window and sum(f < window for f in fills.values()) <= 1


def test_ids_of_texts_are_kept_for_later_tasks(documents):
    assert packing.word_ids(WORDS) is packing.word_ids(WORDS)
    texts = [t or "" for t in ODD + documents + fuzz(400, seed=3)] + ["İi\u0307 \u212a K", "ÅA\u030a Å", "don't 'T ''t", "\x00a\x7f \x1c", "<|endoftext|>x", "a" * 200 + " " + "B" * 200]
    ids_of = packing.WordIds(WORDS)
    for e, text in zip(Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False), texts, strict=True):
        assert ids_of(text) == ids_of(text) == np.array(e.ids, "<u4").tobytes(), text
    # a run of letters takes no search, and an ASCII word one entry of the memo
    words = packing.WordIds(WORDS)
    words.vocabulary.findall, findall = None, words.vocabulary.findall
    try:
        assert words("Every word is letters") and len(words.of_chunk) == 5
    finally:
        words.vocabulary.findall = findall


def test_a_worker_keeps_words_of_one_kind_of_task():
    rows = [pa.RecordBatch.from_pydict({"text": ["a b", "c"]})]
    alive = weakref.ref(packing.word_ids(WORDS))
    assert alive()("a b") and packing.word_ids(WORDS) is alive()
    assert sum(b.num_rows for b in common.sliced(rows, 1, keeps=("word_ids", WORDS))) == 2 and alive()
    for other in (lambda: list(common.sliced(rows, 1)), lambda: list(common.tidied(rows)), lambda: common.kept("other", list)):
        alive = weakref.ref(packing.word_ids(WORDS))
        assert alive()
        other()
        assert alive() is None


def test_level_choice_minimises_the_sum_of_squares():
    rng = random.Random(2)
    for _ in range(300):
        p = packing.SumOfSquares(24)
        p.count[1:24] = [rng.choice([0, 0, 1, 2, 3]) for _ in range(23)]
        length = rng.randrange(1, 25)

        def after(level, p=p, length=length):
            c = p.count.copy()
            if level:
                c[level] -= 1
            if level + length < 24:
                c[level + length] += 1
            return int((c[1:24] ** 2).sum())

        options = [0] + [h for h in range(1, 24) if p.count[h] and h + length <= 24]
        assert after(p.level_for(length)) == min(map(after, options))


def test_many_open_windows_are_drained():
    p = packing.SumOfSquares(100, max_open=5)
    most = 0
    done = [w for i in range(500) for w in p.place((i, 0, bytes(4 * (51 + i % 7)), 51 + i % 7))] + p.finish()
    assert sum(len(x[2]) for w in done for x in w) == sum(4 * (51 + i % 7) for i in range(500))
    assert sum(sum(len(x[2]) for x in w) < 400 for w in done) <= 1
    assert p.n_open == most == 0 and not p.count.any()


def test_empty_tables(spark):
    none = frame(spark, [])
    assert token_count.count_tokens(none, WORDS).count() == 0
    assert bpe.encode_decode(none, BYTES, public_tokenizers.PATTERN).count() == 0
    assert packing.pack(none, WORDS).count() == 0
