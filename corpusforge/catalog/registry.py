"""Registration of queries and the views their comparison SQL may use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..testbed import CORPUS_SQL, LOG_SQL, PREDICTIONS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPACES = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
WORD_CHARS = r"[\p{L}\p{N}_]+"

VIEWS = {
    "corpus": CORPUS_SQL,
    "log": LOG_SQL,
    "predictions": PREDICTIONS_SQL,
    "tok": f"SELECT *, regexp_extract_all(lower(text), '{WORD_CHARS}') AS t FROM corpus WHERE text IS NOT NULL",
    "tlen": "SELECT *, len(t) AS tc FROM tok",
    "wrd": f"SELECT *, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') AS w FROM corpus WHERE text IS NOT NULL",
    "wlen": "SELECT *, len(w) AS wc FROM wrd",
    "lwrd": f"SELECT *, list_filter(regexp_split_to_array(lower(text), '{SPACES}'), lambda x: x <> '') AS w FROM corpus WHERE text IS NOT NULL",
    "bg": "SELECT id, lang, corpus, label, text, batch_idx, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM lwrd",
    "voc": "SELECT DISTINCT lang, corpus, unnest(t) AS token FROM tok",
    "pred": """SELECT *, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 'negative' WHEN z1 >= z2 THEN 'neutral' ELSE 'positive' END AS pred_label,
      1.0 / (exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))) AS conf
      FROM predictions""",
    "cls": """SELECT model, seed, lang, split, x AS label,
      count(*) FILTER (true_label = x AND pred_label = x) AS tp, count(*) FILTER (true_label = x) AS support,
      count(*) FILTER (pred_label = x) AS predicted
      FROM pred CROSS JOIN (SELECT unnest(['negative', 'neutral', 'positive']) AS x) GROUP BY ALL""",
    "f1s": """SELECT model, seed, lang, split, sum(CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END)
      / count(*) FILTER (support + predicted > 0) AS f1, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, sum(support) AS n
      FROM cls GROUP BY ALL""",
    "res": """SELECT model AS config, seed, lang,
      max(f1) FILTER (split = 'seed') AS train_f1, max(accuracy) FILTER (split = 'seed') AS train_accuracy,
      max(f1) FILTER (split = 'valid') AS val_f1, max(accuracy) FILTER (split = 'valid') AS val_accuracy,
      max(f1) FILTER (split = 'test') AS test_f1, max(accuracy) FILTER (split = 'test') AS test_accuracy,
      max(f1) FILTER (split = 'seed') - max(f1) FILTER (split = 'test') AS gap FROM f1s GROUP BY ALL""",
}
NEEDS = {
    "corpus": [], "log": ["corpus"], "predictions": ["corpus"], "tok": ["corpus"], "tlen": ["tok"], "wrd": ["corpus"],
    "wlen": ["wrd"], "lwrd": ["corpus"], "bg": ["lwrd"], "voc": ["tok"], "pred": ["predictions"], "cls": ["pred"],
    "f1s": ["cls"], "res": ["f1s"],
}


def sql(views: str, body: str, doubles: str = "") -> str:
    """Comparison SQL: the named views with what they need, the body, and its doubles rounded."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS[v]:
            add(n)
        if v not in order:
            order.append(v)

    for v in views.split():
        add(v)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    if doubles:
        body = "SELECT * REPLACE (" + ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles.split()) + f") FROM ({body})"
    return f"WITH {head} {body}" if head else body


def tidy(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, so that summation order does not show."""
    return df.select(*[
        (F.round(F.col(f"`{n}`"), 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` with its comparison SQL, if there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return tidy(fn(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
