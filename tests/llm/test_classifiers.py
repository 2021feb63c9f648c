"""Language, quality and toxicity: held-out accuracy and odd rows. WARC: round trips."""

import gzip
import hashlib

import numpy as np
import pytest

from rollcall.llm import langid, queries, quality, toxicity, warc
from rollcall.llm.calibration import Isotonic
from rollcall.llm.common import hash_split

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 !!"), (5, "x" * 20000), (None, "the and of"), (6, "the and of"), (6, "the and of")]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", 0, 0.5) for i, t in ODD], "doc_id bigint, text string, lang string, x int, score double")


def test_language(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op2_kneser_ney_language(spark, SF).collect()
    assert len(rows) == len(truth) and {r.lang_pred for r in rows} <= set(truth.values()) | {"und"}
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.02


def test_language_of_odd_rows(spark):
    learned = langid.fit(spark.createDataFrame([(i, f"the and of {w} house", "en") for i, w in enumerate("abcdefgh")] + [(i + 9, f"le et de {w} maison", "fr") for i, w in enumerate("abcdefgh")], "doc_id bigint, text string, lang string"))
    got = langid.identify(odd(spark), learned).collect()
    assert [r.lang_pred for r in got[:4]] == ["und"] * 4 and all(r.rejected for r in got[:4])
    assert got[5].lang_pred == "en" and len(got) == len(ODD)
    assert langid.identify(odd(spark).limit(0), learned).count() == 0
    nothing = langid.fit(odd(spark).where("false"))
    assert {r.lang_pred for r in langid.identify(odd(spark), nothing).collect()} == {"und"}


STRANGE = [
    "Il governo ha annunciato ieri che la nuova legge sulla scuola entrerà in vigore il prossimo anno, dopo una lunga discussione in parlamento. ",
    "Wczoraj rząd ogłosił, że nowa ustawa o szkolnictwie wejdzie w życie w przyszłym roku po długiej dyskusji w sejmie. ",
    "Hallitus ilmoitti eilen, että uusi koululaki tulee voimaan ensi vuonna pitkän keskustelun jälkeen eduskunnassa. ",
    "Правительство объявило вчера, что новый закон о школе вступит в силу в следующем году после долгого обсуждения. ",
]


def test_strange_languages_are_rejected_at_any_length(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    identifier = langid.fit(documents)
    scorer = langid.Scorer(identifier)
    for letters in (50, 200, 1000, 20000):
        assert langid.decide(identifier, scorer.sums([(t * 200)[:letters] for t in STRANGE]))[2].all(), letters
    clean = [r.text for r in documents.where("text rlike '[a-z]' and doc_id % 10 = 0").select("text").collect()]
    for letters in (50, 200, 1000, 20000):
        assert langid.decide(identifier, scorer.sums([t[:letters] for t in clean]))[2].mean() < 0.005, letters


def test_one_odd_text_does_not_set_the_rejection_limit(spark):
    identifier = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'"))
    rows = [(i, "the house and the garden of the old mill " * (1 + i % 7), "en") for i in range(400)]
    odd_one = [(1000 + i, "zxqj vkw qqzx jjvk " * 2000, "en") for i in range(2)]
    for extra in ([], odd_one):
        identifier.languages, chosen = ["en"], spark.createDataFrame([(r[2], r[1], False) for r in rows + extra], "lang string, text string, fits boolean")
        langid._calibrate(identifier, chosen)
        assert langid.decide(identifier, langid.Scorer(identifier).sums([t[:200] for t in STRANGE]))[2].all()


def test_words_hold_their_marks_and_any_length():
    assert langid.words_of("हिन्दी भाषा, ไทย 12 a_b") == ["हिन्दी", "भाषा", "ไทย", "a", "b"]
    assert langid.words_of("x" * 5000) == ["x" * 5000]


def test_remembered_and_long_words_add_up(spark):
    learned = langid.fit(spark.createDataFrame([(i, f"the and of {w} house", "en") for i, w in enumerate("abcdefgh")], "doc_id bigint, text string, lang string"))
    scorer = langid.Scorer(learned, limit=3)
    texts = ["the " + "a" * 300 + " house", "of and house", "", "the the"]
    for _ in range(3):
        for t, sums in zip(texts, scorer.sums(texts), strict=True):
            words = langid.words_of(t)
            assert np.allclose(sums, learned.score_words(words).sum(axis=0) if words else 0)


def test_language_models_are_distributions():
    words = ["abab", "abc", "cab", "bca", "aab"]
    m = langid.LanguageModel(words, np.array([5, 3, 2, 2, 1]))
    for context in ("", "a", "ab", "ca"):
        total = 0.0
        for symbol in "abcz":
            grams, contexts, word = langid.positions([context + symbol])
            total += 2 ** m.log2(grams, contexts)[len(context)]
        grams, contexts, word = langid.positions([context or "q"])
        total += 2 ** m.log2(grams, contexts)[-1] if context else 0
        assert total <= 1 + 1e-3
    g = langid.positions(["ab"])
    assert len(g[0][0]) == 3 and (g[0][3] == 0).tolist() == [True, True, False]


def evaluated(rows, labels, column):
    pairs = [(labels[r.doc_id][column], r.predicted, r.score) for r in rows if r.doc_id in labels]
    y, p, s = map(np.array, zip(*pairs, strict=True))
    above = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    return (y == p).mean(), above


def f1(rows, labels, column):
    pairs = [(labels[r.doc_id][column], r.predicted) for r in rows if r.doc_id in labels]
    hit = sum(y and p for y, p in pairs)
    return 2 * hit / max(1, sum(y for y, _ in pairs) + sum(p for _, p in pairs))


@pytest.mark.parametrize("query,column,least,sf,balance", [("op6_fourier_quality", "quality", 0.95, SF, 0.9), ("op10_compression_toxicity", "toxic", 0.7, "/root/testdata/sf0.1", 0.45)])
def test_classifiers(spark, query, column, least, sf, balance):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES[query](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 for r in rows)
    assert f1([r for r in rows if r.held_out], labels, column) > balance
    accuracy, area = evaluated([r for r in rows if r.held_out], labels, column)
    assert accuracy > 0.8 and area > least


def test_classifiers_of_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1, 1), (6, 0, 0), (1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        for rows in (quality.fit_and_score(odd(spark), known).collect(), toxicity.score(odd(spark), toxicity.fit(odd(spark), known)).collect()):
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        kept = toxicity.without_toxic(odd(spark), toxicity.fit(odd(spark), known))
        assert kept.columns == odd(spark).columns


def test_windows_cover_whole_texts():
    for n in (1, 11, 12, 13, 47, 48, 49, 84, 85, 1000):
        data = bytes(range(256)) * 4
        found = list(toxicity.spans(data[:n]))
        assert found[0] == data[: toxicity.SPAN][:n] and found[-1][-1:] == data[n - 1 : n]
        assert len(found) * toxicity.STEP + toxicity.SPAN > n
    assert not list(toxicity.spans(b""))


def test_toxic_words_anywhere_in_a_text_count(spark):
    import random

    rng = random.Random(3)
    plain = lambda n: " ".join("".join(rng.choices(["an", "er", "th", "ou", "ing", "le", "st", "re"], k=rng.randrange(1, 5))) for _ in range(n))
    toxic = lambda n: " ".join(plain(8) + " " + rng.choice(["vomiquark", "zubbelfix", "kwogjamm"]) for _ in range(n // 8))
    rows = [(i, plain(rng.randrange(1, 800)) + " " + (toxic(40) if i % 3 == 0 else plain(85)), int(i % 3 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    # as clean as the rest for 3000 words, toxic at the very end
    late = plain(3000) + " " + toxic(600)
    assert model.scorer()([late, plain(4000)]).tolist() == pytest.approx([1, 0], abs=0.3)


def test_conflicting_labels_teach_nothing(spark):
    from rollcall.llm.common import agreed_labels

    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (None, 1), (4, 7)], "doc_id bigint, toxic int")
    assert [tuple(r) for r in agreed_labels(labels, "doc_id", "toxic").collect()] == [(2, 1)]


def test_isotonic():
    f = Isotonic(np.array([1, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]))
    assert f(np.array([0, 1, 2, 3, 3.5, 9])).tolist() == [0, 0, 0.5, 0.5, 0.5, 1]
    assert Isotonic(np.array([]), np.array([]), default=0.2)(np.zeros(2)).tolist() == [0.2, 0.2]


def test_hash_split(spark):
    import zlib

    rows = spark.range(50).select("id", hash_split("id", 5).alias("h")).collect()
    assert all(r.h == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


PAGES = [(7, "http://a/ b\r\nX: y", "<p>" + "z" * 200), (3, None, "<p>" + "z" * 200), (9, "u", "short"), (2, "u", "short"), (4, "u", None), (5, "u", ""), (None, "u", "<p>" + "z" * 200), (3, None, "<p>" + "z" * 200), (8, "u", "WARC/1.1\r\n\r\n" * 30), (10, "u", "é" * 300000)]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id bigint, url string, html string, digest int, payload string")
    listing = warc.archive(pages, str(tmp_path))
    for r in listing.collect():
        data = open(r.path.removeprefix("file:"), "rb").read()
        assert gzip.decompress(data).count(b"WARC-Record-ID") == r.records
        offsets = [list(map(int, line.split("\t")[:2])) for line in open(r.path.removeprefix("file:") + ".idx").read().splitlines()]
        assert sum(n for _, n in offsets) == len(data)
        for at, n in offsets:
            assert gzip.decompress(data[at : at + n]).startswith(b"WARC/1.1\r\n")
    rows = warc.read(listing).collect()
    size = {i: len((h or "").encode()) for i, _, h in PAGES}
    expected = [(7, "revisit", 3), (3, "response", None), (3, "response", None), (None, "revisit", 3), *((i, "response", None) for i in (9, 2, 4, 5, 8, 10))]
    assert sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in rows) == sorted(str((i, size[i], kind, to)) for i, kind, to in expected)
    assert {r.payload_digest for r in rows if r.page_id in (3, 7, None)} == {hashlib.sha256(("<p>" + "z" * 200).encode()).hexdigest()}


def test_normalising_foreign_archives(spark, tmp_path):
    one = warc.page_record(1, "u", b"abc", "d", None)
    two = warc.page_record(2, "u", b"defg", "d", None)
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(one + two))
    (tmp_path / "parts.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    listing = spark.createDataFrame([(str(tmp_path / f), 2, 0) for f in ("whole.warc.gz", "parts.warc.gz")], warc.LISTING)
    assert [r.records for r in warc.normalise(listing, str(tmp_path / "out")).collect()] == [2, 2]
    assert (tmp_path / "out/whole.warc.gz").read_bytes() == (tmp_path / "out/parts.warc.gz").read_bytes()


def test_cut_and_padded_archives():
    import io

    whole = gzip.compress(b"".join(warc.page_record(i, "u", b"x" * 5000, "d", None) for i in range(200)))
    assert len(list(warc.records(warc.inflated(io.BytesIO(whole + b"\0" * 700_000))))) == 200
    assert max(map(len, warc.inflated(io.BytesIO(gzip.compress(b"\0" * 30_000_000))))) <= warc.INFLATED
    engine = __import__("zlib").compressobj(1, 8, 31)
    cut = engine.compress(warc.page_record(1, "u", b"abc", "d", None)) + engine.flush(__import__("zlib").Z_FULL_FLUSH)
    for data in (cut, whole[:-4], whole[:1000]):
        with pytest.raises(ValueError):
            list(warc.records(warc.inflated(io.BytesIO(data))))


def test_a_file_is_written_again(tmp_path):
    for data in (b"first", b"second"):
        with warc.created(str(tmp_path / "x")) as out:
            out.write(data)
    assert (tmp_path / "x").read_bytes() == b"second" and len(list(tmp_path.iterdir())) == 1


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(none).count() == 0


def test_pages_against_duckdb(spark):
    import duckdb

    db = duckdb.connect()
    for t in ("pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in queries.ORACLE_SQL:
        ours = queries.QUERIES[name](spark, SF).toPandas()
        theirs = db.sql(queries.ORACLE_SQL[name]).df()[list(ours.columns)]
        text = lambda df: sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))
        assert text(ours.astype({c: "Int64" for c in ours.columns if ours[c].dtype.kind == "f"})) == text(theirs)
