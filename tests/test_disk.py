"""What the set joins leave on disk: shuffle files of a written table go with it, and tables go once nothing needs them."""

import os

from pyspark.sql import functions as F

from corpusforge.operators import minhash, similarity
from corpusforge.session import discard, materialize, shared_folder


def texts(spark, n=60):
    rows = [(i, "en" if i % 3 else "fr", " ".join(f"w{(i * 7 + j * (1 + i % 4)) % 23}" for j in range(5 + i % 9))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, lang string, text string")


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(1 for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def tables(spark):
    return {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("table-")}


def test_written_table_keeps_no_shuffle_files(spark):
    before, had = shuffled(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    held = materialize(texts(spark).groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    assert shuffled(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == had
    assert {r["lang"]: r["n"] for r in held.collect()} == {"en": 40, "fr": 20}
    there = tables(spark)
    discard(held, texts(spark))  # a frame that is no written table is left alone
    assert len(there) - len(tables(spark)) == 1


def test_sets_are_deleted_when_they_are_compared(spark):
    rows, before = texts(spark), tables(spark)
    for dedup in (similarity.dedup_greedy, minhash.dedup_minhash):
        kept = dedup(rows, ["id"])
        left = [spark.read.parquet(f"{shared_folder(spark)}/{f}") for f in tables(spark) - before]
        assert not any({"grams", "text", "bands"} & set(t.columns) for t in left)
        assert kept.count() == 60 and 0 < kept.where("kept").count() < 60


def test_blocks_meet_in_rounds(spark, monkeypatch):
    """Whatever the number of blocks, a round sends a set once and nothing but its results stay."""
    rows = texts(spark)
    whole = {r["id"]: r["best"] for r in similarity.nearest_similarity(rows).collect()}
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 6)
    before, written = tables(spark), []
    monkeypatch.setattr(similarity, "materialize", lambda df, real=similarity.materialize: written.append(df.columns) or real(df))
    best = similarity.nearest_similarity(rows)
    assert written.count(["rid", "best"]) >= 7  # 40 different texts of a language in blocks of 6
    assert not any("hashes" in spark.read.parquet(f"{shared_folder(spark)}/{f}").columns for f in tables(spark) - before)
    assert {r["id"]: r["best"] for r in best.collect()} == whole
    crossed = similarity.cross_similarity(rows.where("id < 30"), rows.where("id >= 30"))
    assert {r["id"]: r["best"] for r in crossed.collect()} == {
        r["id"]: r["best"] for r in similarity.cross_similarity(rows.where("id < 30"), rows.where("id >= 30").repartition(3)).collect()}


def test_batch_leaves_no_sets_beside_its_index(spark, tmp_path):
    from corpusforge.streaming.index import SetIndex
    from corpusforge.streaming.ingest import judge_batch

    rows, before = texts(spark), tables(spark)
    index = SetIndex(spark, f"{tmp_path}/index", 0.5)
    index.create(rows)
    kept = judge_batch(rows, index, 0, ["id"]).where("outcome = 'accepted'").select("id").collect()
    assert not any({"grams", "text"} & set(spark.read.parquet(f"{shared_folder(spark)}/{f}").columns) for f in tables(spark) - before)
    assert {r["id"] for r in kept} == {r["id"] for r in similarity.dedup_greedy(rows, ["id"]).where("kept").collect()}
    again = judge_batch(rows.withColumn("id", F.col("id") + 100), index, 1, ["id"])
    assert again.where("outcome = 'accepted'").count() == 0


def test_bleu_compares_ngrams_in_turns(spark, monkeypatch):
    """Any number of turns gives the same scores, from small written sums; no n-gram stays in the plan of the report."""
    from corpusforge.operators import bleu

    rows = texts(spark).selectExpr("id", "lang", "'positive' AS label", "text", "CASE WHEN id % 4 = 0 THEN 'seed' ELSE 'syn' END AS corpus")
    got = bleu.bleu_report(rows)
    assert "InArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    values = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x or "" for x in r) for r in df.collect())
    want = values(got)
    for turns in (1, 3):
        monkeypatch.setattr(bleu, "ROUNDS", turns)
        assert values(bleu.bleu_report(rows)) == want
