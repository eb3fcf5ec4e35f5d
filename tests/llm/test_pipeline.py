"""Stages of the pipeline on small documents, and every registered query with SQL on the shared tables."""

import collections

import corpus_pipeline
import pytest
from compare import connect, differences
from weatherloom.llm import catalog
from weatherloom.llm.shared import shared_folder, table

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from".split()


def prose(seed, n=120):
    out = []
    for i in range(n):
        seed = (seed * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[seed % len(WORDS)] if seed % 3 else f"w{seed % 9973}")
        if i % 12 == 11:
            out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="module")
def sf(spark, make_docs, tmp_path_factory):
    rows = [(i, prose(i + 1), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, "BUY!! NOW!! *** " * 30, "en", "s0") for i in range(12)]  # bad
    rows += [(200, rows[5][1], "en", "s1"), (201, rows[5][1] + " tail", "en", "s2"), (5, rows[5][1], "en", "s1")]  # copies
    passage = prose(999, 14)
    rows += [(300, prose(77) + " " + passage, "en", "s0"), (400, None, None, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = make_docs(rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(50)] + [(100 + i, 0, 0) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_each_stage_does_its_part(spark, sf):
    docs = table(spark, sf, "documents")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        after[name] = collections.Counter(r.doc_id for r in docs.collect())
    assert set(range(60)) <= set(after["quality classifier"]) and not set(range(100, 112)) & set(after["quality classifier"])
    dedup = after["near-duplicates"]
    assert dedup[5] == 1 and 200 not in dedup and 201 not in dedup and set(range(60)) <= set(dedup) and 300 in dedup
    assert set(after["decontamination"]) == set(dedup) - {300}
    assert set(after["mixing"]) <= set(after["decontamination"]) and max(after["mixing"].values()) <= 2
    shards = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert collections.Counter(r.doc_id for r in shards.collect()) == after["mixing"]


def test_run_gives_the_last_stage(spark, sf):
    assert {r.law for r in corpus_pipeline.run(spark, sf).collect()} == {"bytes"}
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_on_empty_tables(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - {"op3_sharding"}))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), connect(sf_dir), catalog.SQL[name]) == []


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == shared_folder(spark) and spark.sparkContext.getCheckpointDir()
