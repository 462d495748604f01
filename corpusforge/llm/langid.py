"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prediction where a text is null or has no letter.
UNKNOWN = "und"
_LETTERS: np.ndarray | None = None
_LOWERED: np.ndarray | None = None


@dataclass
class Model:
    """Log-probabilities of the n-gram buckets per language; languages in ascending order."""

    langs: list[str]
    prior: np.ndarray
    matrix: np.ndarray  # buckets x languages


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and their lower case (0 for all others), once per process."""
    global _LETTERS, _LOWERED
    if _LETTERS is None:
        letters = np.zeros(0x110000, bool)
        lowered = np.zeros(0x110000, np.uint32)
        for c in range(0x33480):
            if 0xD800 <= c < 0xE000:
                continue
            s = chr(c)
            if s.isalpha():
                letters[c] = True
                low = s.lower()
                lowered[c] = ord(low) if len(low) == 1 else c
        _LETTERS, _LOWERED = letters, lowered
    return _LETTERS, _LOWERED


def features(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of letters (everything else is one blank): bucket ids, row of each, and rows with a letter."""
    letters, lowered = _tables()
    codes = [np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    size = np.array([c.size + 2 for c in codes], np.int64)
    flat = np.zeros(size.sum(), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    for b, c in zip(begin, codes):
        flat[b + 1:b + 1 + c.size] = c
    low = lowered[flat]
    has = np.zeros(len(texts), bool)
    has[row[letters[flat]]] = True
    keep = np.ones(low.size, bool)  # runs of blanks count once
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0) | (row[1:] != row[:-1])
    low, row = low[keep].astype(np.uint32), row[keep]
    a, b = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
    one = low * a
    ids, rows = [], []
    gram = one.copy()
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] * b + one[n - 1:]
        same = row[:gram.size] == row[n - 1:]
        h = gram ^ (gram >> np.uint32(15))
        h = h * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        same &= (low[:gram.size] != 0) | (low[n - 1:] != 0) if n > 1 else low != 0
        ids.append((h[same] + np.uint32(n)) & np.uint32(buckets - 1))
        rows.append(row[:gram.size][same])
    return np.concatenate(ids), np.concatenate(rows), has


def _pieces(texts: list[str | None], limit: int = 1 << 18):
    """Row ranges of about ``limit`` characters."""
    i, n = 0, 0
    for j, t in enumerate(texts):
        size = len(t or "")
        if j > i and n + size > limit:
            yield i, j
            i, n = j, 0
        n += size
    if i < len(texts):
        yield i, len(texts)


def train(rows: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 1 << 16, smoothing: float = 0.1,
          max_rows: int | None = 40_000, max_langs: int = 1_000) -> Model:
    """Fit the model on the labelled rows of ``rows``.

    Rows with a null text or label are left out. The classifier is fitted on a bounded sample: of more than ``max_rows``
    labelled rows, those with the smallest hashes of their text are taken until about ``max_rows`` are reached (None: all
    rows); prediction covers every row. Repeated rows count as often as they stand there. Without labelled rows the model
    has no language and predicts ``und``. More than ``max_langs`` labels are an error, as the matrix is broadcast.
    """
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    if max_rows is not None:
        total = rows.count()
        if total > max_rows:
            rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(1_000_003 * max_rows / total))
    docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(docs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, tags = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for i, j in _pieces(texts):
                ids, at, _ = features(texts[i:j], buckets)
                for tag in set(tags[i:j]):
                    own = np.array([x == tag for x in tags[i:j]])
                    sums[tag] = sums.get(tag, 0) + np.bincount(ids[own[at]], minlength=buckets)
        for tag, c in sums.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([tag] * some.size, pa.string()), "bucket": pa.array(some, pa.int32()),
                                              "n": pa.array(c[some], pa.int64())})

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(docs)
    matrix = np.full((buckets, len(langs)), smoothing)
    if len(counts):
        where = {x: i for i, x in enumerate(langs)}
        matrix[counts["bucket"].to_numpy(), counts["lang"].map(where).to_numpy()] += counts["n"].to_numpy()
    matrix = np.log(matrix / matrix.sum(axis=0, keepdims=True)) if langs else matrix
    prior = np.array([docs[x] for x in langs], float)
    return Model(langs, np.log(prior / prior.sum()) if langs else prior, matrix.astype(np.float32))


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability per text."""
    out, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return out, sure
    buckets, k = model.matrix.shape
    for i, j in _pieces(texts):
        ids, at, has = features(texts[i:j], buckets)
        sums = np.empty((j - i, k))
        for c in range(k):
            sums[:, c] = np.bincount(at, weights=model.matrix[:, c][ids], minlength=j - i)
        sums += model.prior
        best = sums.argmax(axis=1)
        p = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for d in np.flatnonzero(has):
            out[i + d] = model.langs[best[d]]
            sure[i + d] = p[d]
    return out, sure


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``df`` with the predicted language and its posterior probability (0 to 1).

    ``und`` with score 0 if the text is null or has no letter; equal scores go to the smaller language name. A column that
    is already named ``lang_pred`` or ``score_col`` is replaced. Only the text is looked at.
    """
    df = df.drop(lang_pred, score_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        for batch in batches:
            got, sure = score(shared.value, batch.column(batch.schema.names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string()), pa.array(sure, pa.float64())],
                                             names=[*batch.schema.names, lang_pred, score_col])

    from pyspark.sql import types as T
    schema = T.StructType([*df.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return df.mapInArrow(label, schema)


def held_out(doc_id: str = "doc_id"):
    """The fold that training never sees: crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
