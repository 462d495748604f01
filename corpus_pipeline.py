"""Corpus preparation in five stages; each works on all that its predecessor kept, written as Parquet and reread.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, with any others untouched,
whatever they are called. A null or empty text has no letter and goes in the first stage. Given to a later stage, it stays (secrets, decontamination),
is linked with nothing (near copies) and is encoded as no ids. Repeated rows of one id and text count once from the near copies on; a null id is an id like
any other; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import decontam, jaccard, langid, secret_scan, sentpiece
from corpusforge.llm.tables import materialize, null_join, read, start

#: Leaders per posting list and round of the near copies: at 0.8 a group of copies hangs together loosely, one leader meets few of it.
LEADERS = (1, 8, 8)
#: Documents whose language is less probable than this are rejected.
MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those of no clear language, go. Trained on the documents outside the held-out fold."""
    start(spark)
    model = langid.train(docs.where(~langid.held_out()).select("text", "lang"))
    lang, score = _free(docs, "lang_pred"), _free(docs, "score")
    named = langid.predict(docs, model, lang_pred=lang, score_col=score)
    return named.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have yet (names do not differ by case alone)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _by_text(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents with (left_semi) or without (left_anti) a row of the same id and text."""
    right = rows.select(F.col("doc_id").alias("right_doc"), F.col("text_key").alias("right_key"))
    same = docs["doc_id"].eqNullSafe(right["right_doc"]) & (F.xxhash64(docs["text"]) == right["right_key"])
    return docs.join(right, same, how)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8): the one with the smallest id."""
    start(spark)
    kept = jaccard.cluster(docs, k=5, percent=80, leaders=LEADERS).where("keep")
    key = _free(docs, "text_key")
    once = _by_text(docs, kept, "left_semi").withColumn(key, F.xxhash64("text"))
    return once.dropDuplicates(["doc_id", key]).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word in a ten-word window of a benchmark item go."""
    start(spark)
    leaks = decontam.decontaminate(docs, read(spark, sf_dir, "benchmark")).where("n_hit > 0")
    return _by_text(docs, leaks, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    start(spark)
    spans = _free(docs, "spans")
    found = secret_scan.scan(docs, secret_scan.fit(secret_scan.samples(docs)), spans=spans)
    safe = found.withColumn("text", secret_scan.redact(F.col("text"), F.col(spans)))
    return safe.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with seeded merge-dropout, and the digest of what they decode to."""
    start(spark)
    got = sentpiece.encode_table(docs.select("doc_id", "lang", "source", "text"), sentpiece.model_path(), dropout=0.1, seed=17)
    return got.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_crc32", "decoded_sha256", sentpiece.same_text(got).alias("lossless"))


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("encode", encode_pieces),
]

#: The classifier and the encoder are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    start(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
