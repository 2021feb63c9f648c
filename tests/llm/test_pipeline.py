"""The corpus pipeline, stage by stage."""

import re
from collections import Counter, defaultdict
from itertools import combinations

from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline as cp

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n", __import__("pyspark").sql.functions.lit(1)).cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = cp.drop_toxic(spark, docs, SF).cache()
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    judged = [(i, y) for i, y in labels.items() if y is not None]
    assert sum(i in kept for i, y in judged if y == 0) > 0.9 * sum(y == 0 for _, y in judged)
    assert sum(i not in kept for i, y in judged if y == 1) > 0.6 * sum(y == 1 for _, y in judged)
    known = cp.drop_strange_languages(spark, clean, SF).cache()
    assert known.columns == docs.columns and known.count() > 0.9 * clean.count()
    single = cp.keep_one_of_near_copies(spark, known, SF).cache()
    assert single.columns == docs.columns and 0 < single.count() < known.count()
    assert single.select("text").distinct().count() == single.where("trim(text) <> ''").select("text").distinct().count() + single.where("trim(text) = '' or text is null").select("text").distinct().count()
    packed = cp.pack(spark, single, SF).cache()
    assert packed.select("doc_id").distinct().count() == single.count()


def kept_by_brute_force(texts):
    """Smallest ids of the components of texts that share 80 % of their shingles of five words."""
    sets, holders, shared = {}, defaultdict(list), Counter()
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))} if words else set()
        for shingle in sets[i]:
            holders[shingle].append(i)
    for ids in holders.values():
        shared.update(combinations(sorted(ids), 2))
    least = {i: i for i in texts}
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i for i in texts if least[i] == i}


def test_near_duplicates_and_packing_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    single = cp.keep_one_of_near_copies(spark, docs, SF).cache()
    kept = kept_by_brute_force(texts)
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == sorted(kept) and len(kept) < len(texts)
    tokenizer, pieces, sequences = Tokenizer.from_file(path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    for r in cp.pack(spark, single, SF).collect():
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for cut, ends in ((pieces[i], len(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids) + 1) for i in kept):
        cut.sort()
        assert cut[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(cut, cut[1:], strict=False)) and sum(cut[-1]) == ends
    assert set(pieces) == kept
    for held in sequences.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and sum(held[-1]) <= 4096


def test_the_names_and_order_of_the_stages():
    assert [name for name, _ in cp.STAGES] == ["toxicity", "language", "near_duplicates", "packing"] and cp.ORACLE_SQL is None


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = [(i, f"plain words number {i} of the text", "en", "s", 3) for i in range(30)] + [(None, None, None, None, None), (None, "", "en", "s", 0), (1, "plain words number 1 of the text", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            table = cp.materialise(stage(spark, table, str(tmp_path)))
            table.count()
