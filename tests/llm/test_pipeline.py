"""The pipeline on planted cases, stage by stage and as a whole."""

import cases
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from threadloom.llm import oracles, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("tables"))
    item = cases.prose(999, 30)
    shared = cases.prose(998, 70)
    rows = [(i, cases.prose(2000 + i, 150)) for i in range(10)]
    rows += [
        (20, rows[1][1]), (21, rows[2][1].replace(rows[2][1].split()[70], "other", 1)),
        (30, f"{cases.prose(31, 90)}\n{item}\n{cases.prose(32, 90)}"),
        (40, f"{cases.prose(41, 120)}\n{shared}\n{cases.prose(42, 120)}"),
        (41, f"{cases.prose(43, 120)}\n{shared}\n{cases.prose(44, 120)}"),
        (50, "Home | News | About | Contact\n" * 30), (51, None), (52, ""),
    ]
    cases.documents(spark, rows).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, held = [], {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
        held = {r.doc_id: r.text for r in docs.collect()}
        ids.append(set(held))
    start = set(range(10)) | {20, 21, 30, 40, 41}
    assert ids == [start, start - {20, 21}, start - {20, 21}, start - {20, 21, 30}]
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(held[i] == whole[i] for i in [*range(10), 40])
    assert held[41] == f"{cases.prose(43, 120)}\n{cases.prose(44, 120)}"


def test_stages_keep_other_columns(spark, folder):
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    extra = whole.selectExpr("doc_id", "text", "'mine' n_words", "7 n_removed", "doc_id component_id", "1 item_id", "2 token_ids", "3 _own_n_words")
    for docs in (extra, extra.select("doc_id", "text"), extra.limit(0)):
        first, given = docs, docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            path = f"{folder}/other-{len(given)}-{first.count()}-{k}"
            stage(spark, docs, folder).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == given
        rows = docs.collect()
        assert {r.doc_id for r in rows} == ({*range(10), 40, 41} if first.count() else set())
        if len(given) > 2:
            assert all(r[2:] == ("mine", 7, r.doc_id, 1, 2, 3) for r in rows)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert {r.source for r in last.collect()} <= {None} and last.count() == len(rows)


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == {*range(10), 40, 41}
    assert all(r.decoded_sha256 == r.text_sha256 and r.n_tokens > 0 for r in got)
    assert set(got[0].asDict()) >= {"doc_id", "n_tokens", "token_ids", "ids_sha256"}


def test_registered():
    names = entry_points.queries()
    assert set(queries.registry()) < set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.registry()) == list(range(1, 14))
    assert set(oracles.registry()) <= set(queries.registry())
    assert len(corpus_pipeline.STAGES) == 5
