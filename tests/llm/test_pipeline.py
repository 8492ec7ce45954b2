"""The pipeline's stages against brute force, and all registered queries of the subpackage."""

import duckdb
import pandas as pd
import pytest
import sentencepiece
from odd import no_docs, odd_docs

import __spark_entry__ as entry
import corpus_pipeline
from quillspark.llm import queries, quality, secrets
from quillspark.llm.pieces import MODEL

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return [pd.read_parquet(f"{SF}/documents.parquet"), *out]


def shingles(text, width=5):
    words = text.lower().split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "tokens"]
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[1:5])


def test_quality_stage_keeps_what_scores(stages, spark):
    found = quality.op6_quality(spark, SF).toPandas()
    assert set(stages[1].doc_id) == set(found[found.predicted == 1].doc_id)


def test_near_dedup_stage(stages):
    """No pair of 0.8 or more stays; what goes has a like text."""
    cut = {i: shingles(t) for i, t in zip(stages[1].doc_id, stages[1].text)}
    kept, gone = set(stages[2].doc_id), set(stages[1].doc_id) - set(stages[2].doc_id)
    where = {}
    for i, s in cut.items():
        for x in s:
            where.setdefault(x, []).append(i)
    alike = lambda a, b: len(cut[a] & cut[b]) / len(cut[a] | cut[b])
    near = {i: {j for x in cut[i] for j in where[x] if j != i} for i in cut}
    assert gone and all(max(alike(i, j) for j in near[i]) >= 0.8 - 1e-9 for i in gone)
    assert not [1 for i in kept for j in near[i] if j in kept and i < j and alike(i, j) >= 0.8 - 1e-9]


def test_decontaminate_stage(stages, spark):
    hits = duckdb.connect()
    for t in ("documents", "benchmark"):
        hits.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    dirty = set(hits.sql(entry.oracle_sql()["op9_decontaminate"]).df().doc_id)
    assert set(stages[3].doc_id) == set(stages[2].doc_id) - dirty and dirty & set(stages[2].doc_id)


def test_secrets_stage(stages):
    before = dict(zip(stages[3].doc_id, stages[3].text))
    assert set(before) == set(stages[4].doc_id)
    for r in stages[4].itertuples():
        assert r.text == secrets.redacted(before[r.doc_id]) and r.n_chars == len(r.text)
    assert (stages[4].text.str.contains("[REDACTED]", regex=False)).any()


def test_tokens_stage(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = dict(zip(stages[4].doc_id, stages[4].text))
    assert set(text) == set(stages[5].doc_id) and all(list(r.ids) == library.encode(text[r.doc_id]) for r in stages[5].itertuples())


def test_run_is_the_stages(stages, spark):
    assert corpus_pipeline.run(spark, SF).select("doc_id").toPandas().doc_id.sort_values().tolist() == sorted(stages[5].doc_id)


@pytest.mark.parametrize("docs", [odd_docs, no_docs])
def test_stages_take_odd_tables(spark, docs):
    table = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        assert out.count() <= table.count()
        if name != "tokens":
            assert out.columns == table.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    found = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    keys = list(want.columns[:3])
    show = lambda df: df.astype(object).where(df.notna(), None).sort_values(keys, ignore_index=True)
    pd.testing.assert_frame_equal(show(found), show(want), check_dtype=False)


def test_all_ten_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
