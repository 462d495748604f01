"""Quality report of a corpus and its outcome log."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import bleu, lengths, outcomes, similarity, vocabulary
from ..sources.corpora import only_complete


def quality_report(corpus: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """The tables of the report by name, for languages with complete inputs."""
    c = only_complete(corpus, log)
    l = log.join(c.select(c["lang"].alias("target_lang")).distinct(), "target_lang", "left_semi")
    syn, seed, test = (c.where(f"corpus = '{x}'") for x in ("syn", "seed", "test"))
    return {
        "outcomes": outcomes.outcome_breakdown(l),
        "outcomes_by_label": outcomes.outcome_by_label(l),
        "retry_triggers": outcomes.retry_triggers(l),
        "sentiment_conflict": outcomes.conflict_rate(l, "sentiment_label", "target_label"),
        "language_conflict": outcomes.conflict_rate(l, "lid_lang", "target_lang"),
        "yield": lengths.yield_report(c),
        "integrity": outcomes.integrity(c, l),
        "purity": outcomes.purity(l),
        "tuning": outcomes.tuning_signal(l),
        "chains": outcomes.retry_chains(l),
        "lengths": lengths.word_length_stats(c, ["lang", "corpus"]),
        "length_match": lengths.length_match(c),
        "tail_gap": lengths.tail_gap(c),
        "label_shift": lengths.label_shift(c),
        "coverage": vocabulary.vocab_coverage(c, ["lang"]),
        "bleu": bleu.bleu_report(c),
        "nearest": similarity.nn_similarity(syn),
        "leakage": similarity.leakage_report(syn, test),
        "novelty": vocabulary.novelty(syn, vocabulary.vocabulary(seed, ["lang"]), ["lang"]),
    }
