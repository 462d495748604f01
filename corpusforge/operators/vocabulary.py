"""Vocabulary, n-gram diversity, coverage, novelty and label markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokens
from ..session import join_on
from .lengths import drop_null_text


def vocabulary(corpus: DataFrame, by: list[str]) -> DataFrame:
    """Distinct tokens per group."""
    return drop_null_text(corpus).select(
        *by, F.explode(F.array_distinct(tokens("text"))).alias("token")).distinct()


def gram_counts(corpus: DataFrame, n: int, by: list[str], hashed: bool = False) -> DataFrame:
    """Occurrences of each n-gram per group; ``hashed`` names n-grams by 64 bits, for reports that only count them."""
    grams = F.transform(ngrams("text", n), lambda g: F.xxhash64(g)) if hashed else ngrams("text", n)
    return drop_null_text(corpus).select(*by, F.explode(grams).alias("gram")).groupBy(
        *by, "gram").agg(F.count(F.lit(1)).alias("n"))


def distinct_n(corpus: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Unique over total n-grams; 0.0 for a group without any."""
    stats = gram_counts(corpus, n, by, hashed=True).groupBy(*by).agg(
        F.count(F.lit(1)).alias("unique"), F.sum("n").alias("total"))
    groups = drop_null_text(corpus).select(*by).distinct()
    return join_on(groups, stats, by, "left").select(
        *by, F.coalesce("unique", F.lit(0)).alias("unique"), F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.col("unique") / F.col("total"), F.lit(0.0)).alias(f"distinct_{n}"))


def ttr(corpus: DataFrame, by: list[str]) -> DataFrame:
    """Type-token ratio."""
    return distinct_n(corpus, 1, by).withColumnsRenamed(
        {"unique": "types", "total": "tokens", "distinct_1": "ttr"})


def distinct_rule(corpus: DataFrame, by: list[str], natural: str = "seed", synthetic: str = "syn",
                  floor: float = 0.85) -> DataFrame:
    """Whether a repetition filter would help: synthetic below 85 % of the natural distinct-2."""
    d2 = distinct_n(corpus.where(F.col("corpus").isin(natural, synthetic)), 2, by + ["corpus"])
    side = lambda c, name: d2.where(F.col("corpus") == c).select(*by, F.col("distinct_2").alias(name))
    left, right = side(natural, "natural_d2"), side(synthetic, "syn_d2")
    both = join_on(left, right, by) if by else left.crossJoin(right)  # one row each
    return both.withColumn("ratio", F.try_divide("syn_d2", "natural_d2")).withColumn(
        "filter_useful", F.col("ratio") < floor)


def vocab_entropy(corpus: DataFrame, by: list[str]) -> DataFrame:
    """Shannon entropy of the token distribution in bits: log2(N) - sum(c * log2 c) / N."""
    return gram_counts(corpus, 1, by).groupBy(*by).agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("_s"),
    ).select(*by, "total", (F.log2("total") - F.col("_s") / F.col("total")).alias("entropy"))


def _presence(corpus: DataFrame, by: list[str], names: tuple[str, ...]) -> DataFrame:
    vocab = vocabulary(corpus.where(F.col("corpus").isin(*names)), by + ["corpus"])
    return vocab.groupBy(*by, "token").agg(*[
        F.max(F.when(F.col("corpus") == n, True).otherwise(False)).alias(f"in_{n}") for n in names])


def vocab_coverage(corpus: DataFrame, by: list[str], test: str = "test") -> DataFrame:
    """How much of the test vocabulary the seed and the augmented pools cover."""
    p = _presence(corpus, by, ("seed", "syn", test))
    seed, syn, held = F.col("in_seed"), F.col("in_syn"), F.col(f"in_{test}")
    n = p.groupBy(*by).agg(
        F.count_if(held).alias("test_vocab"), F.count_if(seed).alias("seed_vocab"),
        F.count_if(syn).alias("syn_vocab"), F.count_if(syn & ~seed).alias("syn_new"),
        F.count_if(held & seed).alias("base_covered"), F.count_if(held & (seed | syn)).alias("aug_covered"),
        F.count_if(held & syn & ~seed).alias("newly_covered"), F.count_if(syn & ~held & ~seed).alias("syn_unused"),
        F.count_if(syn & held).alias("syn_in_test"),
    )
    return n.withColumns({
        "base_coverage": F.try_divide("base_covered", "test_vocab"),
        "aug_coverage": F.try_divide("aug_covered", "test_vocab"),
        "improvement_pp": F.try_divide((F.col("aug_covered") - F.col("base_covered")) * 100.0, F.col("test_vocab")),
        "unused_share": F.try_divide("syn_unused", "syn_vocab"),
    })


def vocab_matrix(corpus: DataFrame, by: list[str], names: tuple[str, ...] = ("seed", "syn", "valid", "test")) -> DataFrame:
    """Per cent of the row corpus vocabulary found in each column corpus; one pass over token presence.

    ``aug`` stands for seed and synthetic together when both are named.
    """
    p = _presence(corpus, by, names)
    cols = list(names)
    if "seed" in names and "syn" in names:
        p = p.withColumn("in_aug", F.col("in_seed") | F.col("in_syn"))
        cols.append("aug")
    counts = p.groupBy(*by).agg(*[
        F.count_if(F.col(f"in_{a}") & F.col(f"in_{b}")).alias(f"{a}__{b}") for a in cols for b in cols])
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("corpus"), F.col(f"{a}__{a}").alias("size"), *[
            F.coalesce(F.try_divide(F.col(f"{a}__{b}") * 100.0, F.col(f"{a}__{a}")), F.lit(0.0)).alias(b) for b in cols])
        for a in cols]))
    return counts.select(*by, rows.alias("_r")).select(*by, "_r.*")


def vocab_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tokens of ``a`` that also occur in ``b``."""
    return a.join(b.select("token").distinct(), "token", "left_semi").distinct()


def vocab_new(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tokens of ``a`` that do not occur in ``b``."""
    return a.join(b.select("token").distinct(), "token", "left_anti").distinct()


def vocab_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("token").intersect(b.select("token"))


def vocab_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("token").subtract(b.select("token"))


def vocab_union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select("token") for f in frames]).distinct()


def new_token_counts(rows: DataFrame, known: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """Each row with ``n_new``, the number of its distinct tokens outside the known vocabulary.

    Tokens of the rows are matched against the vocabulary and counted back per row, so
    a token that occurs everywhere is a join key on the small side only.
    """
    exploded = drop_null_text(rows).select(*by, key, F.explode(F.array_distinct(tokens("text"))).alias("token"))
    new = join_on(exploded, known.select(*by, "token").distinct(), by + ["token"], "left_anti")
    counts = new.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n_new"))
    return join_on(drop_null_text(rows), counts, by + [key], "left").withColumn(
        "n_new", F.coalesce("n_new", F.lit(0)))


def novelty(rows: DataFrame, known: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """Distribution of new tokens per text and how many texts fall below each threshold."""
    return new_token_counts(rows, known, by, key).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_new").alias("mean"), F.percentile("n_new", 0.5).alias("median"),
        F.stddev_pop("n_new").alias("std"), F.min("n_new").alias("min"), F.max("n_new").alias("max"),
        *[F.count_if(F.col("n_new") < t).alias(f"below_{t}") for t in (0, 1, 2, 3, 5)],
    )


def min_novelty(rows: DataFrame, known: DataFrame, by: list[str], k: int = 1, key: str = "id") -> DataFrame:
    """Rows that bring at least ``k`` tokens unknown to the vocabulary."""
    return new_token_counts(rows, known, by, key).where(F.col("n_new") >= k)


def label_markers(corpus: DataFrame, by: list[str], min_total: int = 2, min_share: float = 0.66) -> DataFrame:
    """Tokens whose texts carry one label in at least ``min_share`` of ``min_total`` or more texts."""
    exploded = drop_null_text(corpus).select(*by, "label", F.explode(F.array_distinct(tokens("text"))).alias("token"))
    counts = exploded.groupBy(*by, "token", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by, "token").agg(
        F.sum("n").alias("total"), F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("n"))
    return totals.where((F.col("total") >= min_total) & (F.col("n") / F.col("total") >= min_share)).select(
        *by, "token", "label", "n", "total")
