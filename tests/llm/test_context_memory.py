"""What a task holds at once on its way through whole texts."""

from corpusforge import session
from corpusforge.llm import contexts, tables
from pyspark.sql import functions as F

BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def most_rows(df):
    def count(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return df.mapInArrow(count, "n long").agg(F.max("n")).first()[0]


def test_batches_of_whole_texts_are_small(spark):
    other = spark.newSession()  # settings of its own
    rows = lambda: other.range(9_000).coalesce(1)
    tables.start(other)
    assert most_rows(rows()) == session.BATCH_ROWS
    other.conf.set(BATCHES, "10000")  # named by the user
    tables.start(other)
    assert other.conf.get(BATCHES) == "10000" and most_rows(rows()) == 9_000


def test_contexts_go_before_many_are_held(spark):
    text = " ".join(f"w{i}" for i in range(400_000))
    df = spark.createDataFrame([(1, 0, text), (2, 0, text)], "doc long, t int, text string").coalesce(1)
    found = contexts.candidates(df, contexts.Spaced(13))
    kinds, held, most = found.agg(F.countDistinct("h", "cd"), F.sum("held"), F.max("held")).first()
    assert 60_000 < kinds < 200_000 and held == 2 * kinds and most == 1  # the first text's are gone before the second comes
