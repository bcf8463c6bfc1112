from collections import Counter

import corpus_pipeline
from plumbline.llm.mixing import mix

from . import test_line_dedup, test_ngram_join, test_packing, test_quality_rules
from .odd import SCHEMA, documents, empty, odd

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def follow(spark, docs, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    took = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, None).write.parquet(f"{tmp_path}/{name}")
        took[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "best_fit_packing":
            assert docs.columns == took[name][0].columns
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    before, after = took["quality_rules"]
    assert texts(after) == test_quality_rules.brute([(r["doc_id"], r["text"], r["source"]) for r in before.collect()], 20, 0.0)[1]
    before, after = took["line_dedup"]
    assert texts(after) == [(i, t) for i, t in test_line_dedup.brute_short(test_line_dedup.keyed(before)) if len(test_quality_rules.words(t)) >= 10]
    before, after = took["ngram_jaccard_join"]
    each = sorted({(i, t or "") for i, t in texts(before) if i is not None})
    groups = test_ngram_join.brute([(k, t) for k, (_, t) in enumerate(each)])  # of equal rows one, and of each group the first
    assert [(i, t or "") for i, t in texts(after) if i is not None] == sorted((each[k] for k in {c for _, _, c in groups}), key=str)
    assert [x for x in texts(after) if x[0] is None] == [x for x in texts(before) if x[0] is None]
    before, after = took["mixing"]
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(r["doc_id"] for r in mix(before).where("sampled").collect())
    before, after = took["best_fit_packing"]
    test_packing.check(after.collect(), texts(before), 2048)
    return took


def test_stages(spark, sf, tmp_path):
    took = follow(spark, documents(spark, sf).select(*COLUMNS), tmp_path)
    counts = [took[k][0].count() for k in took]
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] > 0


def test_unlike_texts_under_one_id_stay(spark):
    """Nor does a text go because its id has another one that is a copy."""
    a, b = ("one text of more than five words that some other rows copy", "quite another text of which no other row has so much as a word")
    df = spark.createDataFrame([(2, a), (2, b), (2, b), (7, a + " too"), (7, "what only this row says in a few words more"), (None, a)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, None).collect()), key=str)
    assert got == sorted([(2, a), (2, b), (7, "what only this row says in a few words more"), (None, a)], key=str)


def test_odd(spark, tmp_path):
    took = follow(spark, odd(spark), tmp_path)
    assert took["mixing"][1].columns == [x.split()[0] for x in SCHEMA.split(", ")]


def test_empty(spark, tmp_path):
    assert follow(spark, empty(spark), tmp_path)["best_fit_packing"][1].count() == 0
