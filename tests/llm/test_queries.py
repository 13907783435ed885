import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from clickloom.llm.decontaminate import Decontaminator
from clickloom.llm.jaccard_join import JaccardJoin
from clickloom.llm.pii import PiiFinder
from clickloom.llm.quality import QualityClassifier
from clickloom.llm.queries import ORACLE, QUERIES
from clickloom.llm.tables import read
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= queries().keys() and ORACLE.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", list(ORACLE))
def test_against_sql(spark, name):
    verdict = compare(spark, connect(SF_DIR), QUERIES[name], ORACLE[name], SF_DIR)
    assert verdict == "" or verdict.startswith("(")


def test_pipeline_against_stage_by_stage_brute_force(spark):
    from tests.llm.test_decontaminate import brute_force as hits
    from tests.llm.test_jaccard_join import brute_force as groups

    docs = read(spark, SF_DIR, "documents")
    labels, benchmark = read(spark, SF_DIR, "labels"), read(spark, SF_DIR, "benchmark")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    good = {r["doc_id"] for r in QualityClassifier().classify(docs, labels).collect() if r["predicted"]}
    kept = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    first = {i for i, _, c in groups(kept, 5, 80) if i == c}
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    left = {i: t for i, t in kept if i in first and 2 * hits(t, items, 10)[1] <= max(1, 2 * hits(t, items, 10)[0]) * 0.5}
    assert got.keys() == left.keys()
    assert all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in got.values())


def test_every_stage_keeps_columns_and_clean_documents(spark, docs_of):
    clean = [(k, f"clean text number {'abcdefghij'[k]} of this corpus with words of its own {'klmnopqrst'[k] * 4}") for k in range(10)]
    docs = docs_of([*clean, (20, clean[0][1]), (None, None), (21, "")], "lang string, source string, n_chars bigint, cell bigint, n bigint")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        texts = {r["doc_id"]: r["text"] for r in out.collect()}
        assert {i: texts[i] for i, _ in clean} == dict(clean), name
        assert (20 in texts) == (name != "near_duplicates"), name
        assert texts[None] is None and texts[21] == "", name


def test_classes_stay_with_repeated_runs(spark):
    docs = read(spark, SF_DIR, "documents")
    one, two = (sorted(map(tuple, JaccardJoin().classes(docs.repartition(n)).collect())) for n in (1, 5))
    assert one == two


def test_operators_take_tables_without_rows(spark):
    docs, labels = read(spark, SF_DIR, "documents").limit(0), read(spark, SF_DIR, "labels").limit(0)
    benchmark = read(spark, SF_DIR, "benchmark")
    assert QualityClassifier().keep(docs, labels).count() == 0
    assert Decontaminator().remove(docs, benchmark).count() == 0
    assert PiiFinder().redact(docs).count() == 0
