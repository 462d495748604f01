"""Length profiles, gaps and label shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABELS, SENTENCES_PER_SEED, SHARE_BUCKETS
from ..functions.numeric import pct
from ..functions.rules import length_flag
from ..functions.text import length_bucket_of, token_count, word_count
from .ranking import nth_rows


def drop_null_text(corpus: DataFrame) -> DataFrame:
    return corpus.na.drop(subset=["text"])


def with_words(corpus: DataFrame) -> DataFrame:
    return drop_null_text(corpus).withColumn("wc", word_count("text"))


def with_tokens(corpus: DataFrame) -> DataFrame:
    return drop_null_text(corpus).withColumn("tc", token_count("text"))


def _quantiles(col: str, points: dict[str, float]) -> list[Column]:
    """Linear-interpolation quantiles; lengths have few distinct values, so the state stays small."""
    return [F.percentile(col, p).alias(n) for n, p in points.items()]


def _whole(x: Column) -> Column:
    """Whole part of an interpolated length, the rounding error of the interpolation aside."""
    return F.floor(x + 1e-9).cast("int")


def length_profile(corpus: DataFrame, by: list[str]) -> DataFrame:
    """Words per text: mean, sample std, quantiles cut to whole words, min and max."""
    cuts = {"p10": .10, "p25": .25, "p50": .50, "p75": .75, "p90": .90, "p95": .95}
    stats = with_words(corpus).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("wc").alias("mean"), F.stddev_samp("wc").alias("std"),
        *_quantiles("wc", cuts), F.min("wc").alias("min"), F.max("wc").alias("max"),
    )
    return stats.withColumns({c: _whole(F.col(c)) for c in cuts})


def length_examples(corpus: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """Short, medium and long example texts at 10, 50 and 90 per cent of the length order."""
    n = F.col("_size")
    picks = {
        "short": F.greatest(F.lit(0), F.floor(n * 0.10)),
        "medium": F.floor(n * 0.50),
        "long": F.least(n - 1, F.floor(n * 0.90)),
    }
    rows = nth_rows(with_words(corpus), by, "wc", key, picks)
    return rows.groupBy(*by).agg(*[
        F.max(F.when(F.col("pick") == p, F.col("text"))).alias(p) for p in picks
    ])


def seed_profile(seeds: DataFrame, by: list[str]) -> DataFrame:
    """Length statistics and examples of each group, as two struct columns."""
    stats = length_profile(seeds, by)
    examples = length_examples(seeds, by)
    fields = [c for c in stats.columns if c not in by]
    left = stats.select(*by, F.struct(*fields).alias("lengths"))
    right = examples.select(*by, F.struct("short", "medium", "long").alias("examples"))
    return left.join(right, by)


def label_dist(corpus: DataFrame, by: list[str]) -> DataFrame:
    """Rows and share per label within each group."""
    counts = corpus.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(totals, by).withColumn("share", F.col("n") / F.col("total"))


def corpus_sizes(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))


def token_length_stats(corpus: DataFrame, by: list[str]) -> DataFrame:
    """Tokens per text with the population std, as used by the corpus comparison reports."""
    cuts = {"p5": .05, "p10": .10, "p25": .25, "p50": .50, "p75": .75, "p90": .90, "p95": .95}
    return with_tokens(corpus).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("tc").alias("mean"), F.stddev_pop("tc").alias("std"),
        *_quantiles("tc", cuts), F.min("tc").alias("min"), F.max("tc").alias("max"),
    )


def word_length_stats(corpus: DataFrame, by: list[str]) -> DataFrame:
    """Words per text with the sample std, whole-word median and p95."""
    return with_words(corpus).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("wc").alias("mean"), F.stddev_samp("wc").alias("std"),
        F.min("wc").alias("min"), F.max("wc").alias("max"),
        _whole(F.percentile("wc", 0.5)).alias("median"), _whole(F.percentile("wc", 0.95)).alias("p95"),
    )


def bucket_shares(corpus: DataFrame, by: list[str]) -> DataFrame:
    """Per cent of texts in each length range; longer texts count in the denominator only."""
    return with_tokens(corpus).groupBy(*by).agg(*[
        F.avg(F.when(F.col("tc").between(lo, hi), 100.0).otherwise(0.0)).alias(f"b{lo}_{hi}")
        for lo, hi in SHARE_BUCKETS
    ])


def length_by_label(corpus: DataFrame, by: list[str]) -> DataFrame:
    return with_tokens(corpus).groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("tc").alias("mean"), F.stddev_pop("tc").alias("std"),
        F.percentile("tc", 0.05).alias("p5"), F.percentile("tc", 0.95).alias("p95"),
    )


def _when(corpus: str, value: Column) -> Column:
    return F.when(F.col("corpus") == corpus, value)


def length_match(corpus: DataFrame) -> DataFrame:
    """Synthetic against seed lengths per language and label, with a verdict; needs two rows on each side."""
    wc = F.col("wc")
    stats = with_words(corpus).groupBy("lang", "label").agg(
        F.count(_when("seed", wc)).alias("seed_n"), F.count(_when("syn", wc)).alias("syn_n"),
        F.avg(_when("seed", wc)).alias("seed_mean"), F.avg(_when("syn", wc)).alias("syn_mean"),
        F.stddev_samp(_when("seed", wc)).alias("seed_std"), F.stddev_samp(_when("syn", wc)).alias("syn_std"),
    ).where((F.col("seed_n") > 1) & (F.col("syn_n") > 1))
    return stats.withColumns({
        "mean_diff": F.col("syn_mean") - F.col("seed_mean"),
        "std_ratio": F.try_divide("syn_std", "seed_std"),
    }).withColumn("verdict", length_flag("std_ratio", "mean_diff"))


def tail_gap(corpus: DataFrame, corpora: tuple[str, ...] = ("seed", "syn", "test")) -> DataFrame:
    """Std, p95 and share of texts over 30 words side by side for each corpus."""
    wc = F.col("wc")
    aggs = []
    for c in corpora:
        aggs += [
            F.stddev_samp(_when(c, wc)).alias(f"{c}_std"),
            _whole(F.percentile(_when(c, wc), 0.95)).alias(f"{c}_p95"),
            (F.avg(_when(c, F.when(wc > 30, 1.0).otherwise(0.0))) * 100).alias(f"{c}_over30"),
        ]
    return with_words(corpus).groupBy("lang", "label").agg(*aggs)


def outside_range(corpus: DataFrame, by: list[str], inner: str = "syn", outer: str = "test") -> DataFrame:
    """Rows of ``outer`` whose length lies outside the p5..p95 range of ``inner``."""
    hist = with_tokens(corpus).groupBy(*by, "corpus", "tc").agg(F.count(F.lit(1)).alias("n"))
    bounds = hist.where(F.col("corpus") == inner).groupBy(*by).agg(
        F.percentile("tc", 0.05, F.col("n")).alias("p5"), F.percentile("tc", 0.95, F.col("n")).alias("p95"))
    probe = hist.where(F.col("corpus") == outer)
    joined = probe.join(bounds, by) if by else probe.crossJoin(bounds)
    off = (F.col("tc") < F.col("p5")) | (F.col("tc") > F.col("p95"))
    return joined.groupBy(*by, "p5", "p95").agg(
        F.sum(F.when(off, F.col("n")).otherwise(0)).alias("outside"), F.sum("n").alias("total"),
    ).withColumn("pct", F.col("outside") * 100.0 / F.col("total"))


def mix_ratio(corpus: DataFrame, by: list[str], batch: int = 16) -> DataFrame:
    """Seed and synthetic shares of the augmented set and rows of each expected per training batch."""
    n = corpus.where(F.col("corpus").isin("seed", "syn")).groupBy(*by).agg(
        F.count_if(F.col("corpus") == "seed").alias("seed_n"),
        F.count_if(F.col("corpus") == "syn").alias("syn_n"),
    )
    total = F.col("seed_n") + F.col("syn_n")
    return n.withColumns({
        "seed_pct": F.col("seed_n") * 100.0 / total, "syn_pct": F.col("syn_n") * 100.0 / total,
        "seed_per_batch": F.col("seed_n") * float(batch) / total,
        "syn_per_batch": F.col("syn_n") * float(batch) / total,
    })


def length_kl(corpus: DataFrame, by: list[str], p: str = "seed", q: str = "syn") -> DataFrame:
    """KL(p || q) over length bins [0,2), [2,4) ... [46,48), [48,100]; longer texts are left out."""
    last = 24
    binned = with_tokens(corpus).where((F.col("tc") <= 100) & F.col("corpus").isin(p, q)).withColumn(
        "bin", F.least(F.floor(F.col("tc") / 2), F.lit(last)))
    counts = binned.groupBy(*by, "bin").agg(
        F.count_if(F.col("corpus") == p).alias("p"), F.count_if(F.col("corpus") == q).alias("q"))
    wide = counts.groupBy(*by).agg(
        F.sum("p").alias("pn"), F.sum("q").alias("qn"),
        F.collect_list(F.struct("bin", "p", "q")).alias("bins"),  # at most 25 entries
    )
    eps = 1e-10
    term = lambda b: (b["p"] / F.col("pn") + eps) * F.log((b["p"] / F.col("pn") + eps) / (b["q"] / F.col("qn") + eps))
    # a bin empty on both sides contributes eps * ln(1) = 0
    return wide.where((F.col("pn") > 0) & (F.col("qn") > 0)).select(
        *by, F.aggregate(F.transform(F.array_sort("bins"), term), F.lit(0.0), lambda s, v: s + v).alias("kl"))


def yield_report(corpus: DataFrame, per_seed: int = SENTENCES_PER_SEED) -> DataFrame:
    """Expected against actual synthetic rows, with the label shares of both corpora."""
    return _side_by_side(corpus).select(
        "lang", F.col("seed_n").alias("seed_count"), (F.col("seed_n") * per_seed).alias("expected"),
        F.col("syn_n").alias("actual_synth"), (F.col("seed_n") * per_seed - F.col("syn_n")).alias("shortfall"),
        pct(F.col("syn_n"), F.col("seed_n") * per_seed).alias("yield_pct"),
        *[f"{c}_{x[:3]}_pct" for c in ("seed", "syn") for x in LABELS],
    )


def label_shift(corpus: DataFrame) -> DataFrame:
    """Label shares of seed and synthetic rows and their difference in points."""
    both = _side_by_side(corpus)
    return both.select("lang", *[c for x in LABELS for c in (
        F.col(f"seed_{x[:3]}_pct"), F.col(f"syn_{x[:3]}_pct"),
        (F.col(f"syn_{x[:3]}_pct") - F.col(f"seed_{x[:3]}_pct")).alias(f"diff_{x[:3]}"))])


def _side_by_side(corpus: DataFrame) -> DataFrame:
    aggs = []
    for c in ("seed", "syn"):
        aggs.append(F.count_if(F.col("corpus") == c).alias(f"{c}_n"))
        for x in LABELS:
            aggs.append(F.count_if((F.col("corpus") == c) & (F.col("label") == x)).alias(f"{c}_{x[:3]}"))
    wide = corpus.where(F.col("corpus").isin("seed", "syn")).groupBy("lang").agg(*aggs)
    return wide.withColumns({
        f"{c}_{x[:3]}_pct": pct(F.col(f"{c}_{x[:3]}"), F.col(f"{c}_n")) for c in ("seed", "syn") for x in LABELS
    })


def length_range(corpus: DataFrame, by: list[str], reference: str = "seed", target: str = "syn") -> DataFrame:
    """Rows of ``target`` whose token count lies within p5..p95 of ``reference``."""
    rows = with_tokens(corpus)
    bounds = rows.where(F.col("corpus") == reference).groupBy(*by).agg(
        F.percentile("tc", 0.05).alias("p5"), F.percentile("tc", 0.95).alias("p95"))
    return rows.where(F.col("corpus") == target).join(bounds, by).where(F.col("tc").between(F.col("p5"), F.col("p95")))


def bucket_counts(corpus: DataFrame, by: list[str]) -> DataFrame:
    return with_tokens(corpus).withColumn("bucket", length_bucket_of(F.col("tc"))).groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("n"))
