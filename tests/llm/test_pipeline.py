from collections import Counter

import corpus_pipeline
import fixtures

from inkframe.llm import language, mixing, simhash
from test_packing import check

SF_DIR = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(spark, docs, SF_DIR)
        rows = out.collect()
        if name != "pack":
            assert out.columns == docs.columns
            whole = Counter(before)
            assert all(r in whole for r in rows)
        if name == "language":
            named = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.label_languages(docs).collect()}
            assert {r["doc_id"] for r in rows} == {k for k, (v, s) in named.items() if v != "und" and s >= corpus_pipeline.LEAST_SCORE}
        elif name == "simhash":
            groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(docs).collect()}
            assert sorted(r["doc_id"] for r in rows) == sorted(set(groups.values()))
        elif name == "mix":
            assert Counter(rows) == Counter(r["row"] for r in mixing.mix_sources(docs).collect())
        else:
            used, least = check(rows, before, 2048)
            assert used <= least + 1
        docs = spark.createDataFrame(rows, out.schema)


def test_awkward_documents(spark):
    for docs in (fixtures.awkward(spark), fixtures.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            if name != "pack":
                assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(got.columns)
