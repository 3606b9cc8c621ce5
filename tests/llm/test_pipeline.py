import collections

import corpus_pipeline as C
from civiclake.session import materialise
from llm.odd import edited, prose


def test_stages_do_their_part(spark, tmp_path):
    text = lambda i, n=80: f"{prose(i, n)} end{i}"
    rows = [(i, text(i), "en", f"s{i % 3 and 1}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s1", 0), (101, edited(rows[1][1], 40), "en", "s1", 0), (102, "too short", "en", "s1", 0)]
    rows += [(103 + k, "$ " * 30 + text(300 + k), "en", "s1", 0) for k in range(30)]
    rows += [(140, prose(140, 30) + " " + prose(777, 25) + " " + prose(141, 30), "en", "s0", 0), (150, None, None, None, None)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(103 + k, 0, 0) for k in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, prose(777, 25))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in C.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == columns
            seen[name] = collections.Counter(r["doc_id"] for r in docs.collect())
    clean = set(range(60))
    assert set(seen["quality_rules"]) == clean | {100, 101, 140}
    assert seen["jaccard_join"] == collections.Counter(clean | {140})
    assert seen["decontamination"] == collections.Counter(clean)
    assert set(seen["mixing"]) == clean
    packed = collections.Counter(d for r in docs.collect() for d in r["doc_ids"])
    assert packed == seen["mixing"]
    assert C.run(spark, sf).count() == docs.count()


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{sf}/{name}.parquet")
    assert C.run(spark, sf).count() == 0
