"""Similarities of neighbouring documents: the sets of a text are made once."""

from corpusforge.catalog import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pair_sets_are_made_once_a_text(spark, tmp_path):
    texts = {0: "a b c d", 1: "a b c", 63: "abc def ghi", 64: "abc def", 65: None, 66: "x y", -1: "a b"}
    docs = [(i, "en", t) for i, t in texts.items()] + [(1, "en", "b c d"), (None, "en", "a b"), (64, "en", "abc def")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["pair_similarities"](spark, str(tmp_path))
    assert plan_of(got).count("(?=(...))") == 1
    assert sorted((r["id"], round(r["jaccard_bigram"] or 0, 3)) for r in got.collect()) == [
        (-1, 0.333), (0, 0.667), (0, 0.667), (63, 0.5), (63, 0.5), (64, 0.0), (64, 0.0), (65, 0.0)]
