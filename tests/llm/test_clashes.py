"""Stages and language ID on documents that have columns of the operators' own names."""

import pytest

from readloom.llm import common, langid


def test_predict_keeps_columns_of_its_own_names(spark):
    rows = [(i, "the and with from" if i % 2 else "und nicht auch sehr", "en" if i % 2 else "de", f"s{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").selectExpr("*", "'x' as id", "'y' as lang_pred", "'z' as ambiguous")
    out = langid.predict(docs, langid.fit(docs), keep=("score", "id", "lang", "lang_pred", "ambiguous", "text"))
    assert out.columns == ["id", "lang_pred", "score", "ambiguous", "score_", "id_", "lang", "lang_pred_", "ambiguous_", "text"]
    for r in out.collect():
        assert r.score_ == f"s{r.id}" and (r.id_, r.lang_pred_, r.ambiguous_) == ("x", "y", "z") and r.lang_pred == r.lang


def test_stages_keep_clashing_columns(spark, sf, edge):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = edge.selectExpr("*", "'a' as lang_pred", "'b' as ambiguous", "'c' as epochs", "'d' as taken", "'e' as c0", "'f' as some", "'g' as __k")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.select("lang_pred", "ambiguous", "epochs", "__k").distinct().collect() == [("a", "b", "c", "g")], name
    pieces = pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.filter("start = 0").count() == docs.count()


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
