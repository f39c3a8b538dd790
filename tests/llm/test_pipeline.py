from __future__ import annotations

from collections import Counter

import corpus_pipeline
from motifold.llm import bpe, mixing, ngram_join, quality_rules, queries, secrets

SF = "/root/testdata/sf0.001"


def test_stages_follow_from_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = {r.doc_id for r in quality_rules.rate(docs).where("kept").collect()}
    first = corpus_pipeline.rules(spark, docs, SF).cache()
    assert {r.doc_id for r in first.collect()} == kept
    groups = {r.doc_id: r.component_id for r in ngram_join.link(first).collect()}
    second = corpus_pipeline.near_duplicates(spark, first, SF).cache()
    assert sorted(r.doc_id for r in second.collect()) == sorted(set(groups.values()))
    third = corpus_pipeline.scan(spark, second, SF).cache()
    assert all(r.n_chars == len(r.text) for r in third.collect())
    assert secrets.scan(third).where("n_assign + n_access + n_hex > 0").count() == 0
    fourth = corpus_pipeline.mix(spark, third, SF).cache()
    taken = {r.doc_id: r.taken // r.size for r in mixing.plan(third).collect() if r.size}
    assert Counter(r.doc_id for r in fourth.collect()) == Counter({i: n for i, n in taken.items() if n})
    for step in (first, second, third, fourth):
        assert step.columns == docs.columns
    last = corpus_pipeline.encode(spark, fourth, SF).collect()
    texts = {r.doc_id: r.text for r in fourth.collect()}
    own = bpe.encoder(queries.vocabulary())
    assert len(last) == fourth.count() and all(r.text == texts[r.doc_id] and r.ids == own.encode(r.text).tolist() for r in last)
    assert corpus_pipeline.run(spark, SF).count() == len(last)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, label string, `block` int, `stays` int, size long, ids string"


def test_odd_rows_in_each_stage(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that stages use themselves."""
    words = lambda seed, n: " ".join(f"{'abcdefgh'[(k * k + seed) % 8]}{(k * 7919 + seed * 104729) % 9973}" for k in range(n))
    key = "password = hunter2hunter2 and api_key: 'Zx81abcDEF99'"
    texts = [(1, words(1, 80)), (2, words(1, 80)), (2, words(1, 80)), (3, words(2, 80) + "\n" + key), (3, words(3, 90)), (4, None), (5, ""), (6, " \n"), (None, words(4, 70)), (None, words(4, 70)), (7, words(5, 30_000)), (8, words(5, 30_000) + " end"), (9, "x " * 400), (10, words(6, 50))]
    rows = [(i, t, "en", (None, "a", "b")[k % 3], len(t or ""), 5, "l", 6, 7, 8, "y") for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS)
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    first = corpus_pipeline.rules(spark, docs, SF)
    assert plain(first) == sorted([r for r in rows if len((r[1] or "").split()) >= 50 and r[0] != 9], key=str)
    second = corpus_pipeline.near_duplicates(spark, first, SF)
    assert sorted((str(r.doc_id), len(r.text)) for r in second.collect()) == sorted([(str(i), len(t)) for i, t in texts if i in (1, 3, 7, 10)] + [("None", len(words(4, 70)))] * 2)
    odd = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in odd.where("doc_id in (4, 5, 6) or doc_id is null").collect()) == ["4", "5", "6", "None", "None"]
    third = corpus_pipeline.scan(spark, docs, SF)
    assert third.count() == len(rows) and third.where("text is null").count() == 1 and third.where("text like '%hunter2%'").count() == 0
    assert all(tuple(r) in rows for r in third.where("text is null or text not like '%[secret]%'").collect())
    assert [r.n_chars for r in third.where("text like '%[secret]%'").collect()] == [len(r.text) for r in third.where("text like '%[secret]%'").collect()]
    fourth = corpus_pipeline.mix(spark, docs, SF)
    assert set(map(tuple, fourth.collect())) <= set(rows) and max(Counter(map(tuple, fourth.collect())).values()) <= 4
    fifth = corpus_pipeline.encode(spark, docs, SF)
    own = bpe.encoder(queries.vocabulary())
    assert sorted(((str(r.doc_id), r.ids, r.text) for r in fifth.collect()), key=str) == sorted(((str(i), own.encode(t or "").tolist(), t or "") for i, t in texts), key=str)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.encode(spark, docs.limit(0), SF).count() == 0
