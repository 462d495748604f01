"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize

# The base patterns, with the least length of their value.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN = 12
KINDS = ("assign", "access", "hex", "markov")

#: What the models judge: unbroken strings of key-like characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(1, len(_ALPHABET) + 1)  # 0: before the first character
_SIZE = len(_ALPHABET) + 1


@dataclass
class Model:
    """Log-likelihood ratio of each transition (random over ordinary); none if a class had no sample."""

    ratio: np.ndarray | None
    min_total: float = 12.0
    min_mean: float = 0.4

    def random_like(self, token: str) -> bool:
        if self.ratio is None:
            return False
        steps = self.ratio[_transitions(token)]
        return bool(steps.sum() >= self.min_total and steps.mean() >= self.min_mean)


def _transitions(token: str) -> np.ndarray:
    codes = _CODE[np.frombuffer(token.encode("ascii", "replace"), np.uint8) & 127]
    return np.concatenate([[0], codes[:-1]]) * _SIZE + codes


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the pattern matches; leftmost and non-overlapping per kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def _free(spans, start: int, end: int) -> bool:
    return all(end <= s[0] or start >= s[2] for s in spans)


def _values(text: str, spans) -> list[str]:
    return [t for s in spans for t in CANDIDATE.findall(text[s[3]:s[2]])]


def labelled(text: str) -> tuple[list[str], list[str]]:
    """Samples for the models: values of base matches (random), and other unbroken strings (ordinary)."""
    spans = base_spans(text)
    random = _values(text, spans)
    ordinary = [m[0] for m in _IDENTIFIER.finditer(text) if _free(spans, m.start(), m.end())]
    return random, ordinary


def _transition_counts(samples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Transition counts per class of rows (random: boolean, token); the table has a fixed size."""

    def count(batches):
        sums = np.zeros((2, _SIZE * _SIZE), np.int64)
        for batch in batches:
            for random, token in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                np.add.at(sums[int(random)], _transitions(token), 1)
        for random in (0, 1):
            some = np.flatnonzero(sums[random])
            yield pa.RecordBatch.from_pydict({"random": pa.array([bool(random)] * some.size, pa.bool_()), "step": pa.array(some, pa.int32()),
                                              "n": pa.array(sums[random][some], pa.int64())})

    got = samples.mapInArrow(count, "random boolean, step int, n long").groupBy("random", "step").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, _SIZE * _SIZE))
    if len(got):
        out[got["random"].to_numpy().astype(int), got["step"].to_numpy()] = got["n"].to_numpy()
    return out[1], out[0]


def fit(samples: DataFrame, token: str = "token", random: str = "random", **limits) -> Model:
    """Models from labelled samples: ``random`` is true for random strings, false for ordinary identifiers.

    Rows with nulls and empty tokens are left out; without samples of either class the model finds nothing.
    """
    rows = samples.select(F.col(random).alias("random"), F.col(token).alias("token")).where("random IS NOT NULL AND token <> ''")
    counts = _transition_counts(rows)
    if not all(c.sum() for c in counts):
        return Model(None, **limits)
    p = []
    for c in counts:
        c = c.reshape(_SIZE, _SIZE)
        single = (c.sum(axis=0) + 0.5) / (c.sum() + 0.5 * _SIZE)  # rare transitions lean on the character's own share
        p.append(np.log((c + 25 * single) / (c.sum(axis=1, keepdims=True) + 25)))
    return Model((p[0] - p[1]).ravel(), **limits)


def samples(df: DataFrame, text: str = "text", max_rows: int = 20_000, max_random: int = 20_000) -> DataFrame:
    """Labelled samples out of texts, labelled by the base patterns.

    Each class is bounded by itself. Random strings come from all texts: of more than ``max_random``, about so many with the smallest
    hashes. Ordinary ones come from a sample of texts: of more than ``max_rows``, about so many with the smallest hashes.
    """
    rows = df.select(F.col(text).alias("text")).where("text IS NOT NULL")
    total = rows.count()
    rows = rows.withColumn("both", _least("text", max_rows, total))

    def take(batches):
        for batch in batches:
            for t, both in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                random, ordinary = labelled(t) if both else (_values(t, base_spans(t)), [])
                if random or ordinary:
                    yield pa.RecordBatch.from_pydict({"random": pa.array([True] * len(random) + [False] * len(ordinary), pa.bool_()),
                                                      "token": pa.array(random + ordinary, pa.string())})

    found = materialize(rows.mapInArrow(take, "random boolean, token string"))
    return found.where(~F.col("random") | _least("token", max_random, found.where("random").count()))


def _least(column: str, most: int, total: int) -> Column:
    """Whether a row is among about ``most`` of ``total`` with the smallest hashes."""
    return F.lit(True) if total <= most else F.pmod(F.xxhash64(column), F.lit(1_000_003)) < int(1_000_003 * most / total)


def find(text: str, model: Model) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets of a text: the base spans, and what the models add outside of them."""
    spans = base_spans(text)
    more = [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text)
            if model.random_like(m[0]) and _free(spans, m.start(), m.end())]
    return sorted([s[:3] for s in spans] + more)


def scan(df: DataFrame, model: Model, text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """All rows and columns with ``spans``: array of (kind, start, end), by start and then kind; code points, end exclusive.

    A null text counts as empty; every whole text is read. An existing column of that name is replaced.
    """
    from pyspark.sql import types as T

    df = df.drop(spans)
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def mark(batches):
        for batch in batches:
            got = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t or "", shared.value)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], names=[*batch.schema.names, spans])

    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return df.mapInArrow(mark, T.StructType([*df.schema.fields, T.StructField(spans, T.ArrayType(item))]))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch covered by spans replaced by ``mark``; overlapping spans count as one. Null stays null."""
    step = "struct<end:int,out:string>"
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("out")).cast(step)

    def add(acc, s):
        fresh = F.concat(acc["out"], F.substr(text, acc["end"] + 1, s["start"] - acc["end"]), F.lit(mark))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"),
                        F.when(s["start"] >= acc["end"], fresh).otherwise(acc["out"]).alias("out")).cast(step)

    def finish(acc):
        return F.concat(acc["out"], F.substr(text, acc["end"] + 1, F.greatest(F.length(text) - acc["end"], F.lit(0))))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, finish)).otherwise(text)
