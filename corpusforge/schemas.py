"""Schemas of the stored tables and of model responses."""

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CORPUS = _struct(id=_L, text=_S, label=_S)

SENTENCE = _struct(
    sid=_L, seed_id=_L, plan_id=_I, strategy=_S, preserve=_S, domain=_S, style=_S,
    sentiment_expression=_S, text=_S, target_label=_S, target_lang=_S, retry_count=_I,
    prev_feedback=_S, sentiment_label=_S, sentiment_conf=_D, sv_verdict=_S, sv_cot=_S,
    sv_feedback=_S, lid_lang=_S, lid_conf=_D, lv_verdict=_S, lv_cot=_S, lv_feedback=_S,
)

# outcome log: sentence rows plus the fields of batch_failed rows
LOG = T.StructType(SENTENCE.fields + _struct(
    outcome=_S, batch_idx=_L, seed_ids=T.ArrayType(_L), expected_sentences=_I).fields)

PLAN_RESPONSE = _struct(seed_analyses=T.ArrayType(_struct(
    seed_id=_L, domain=_S, style=_S, sentiment_expression=_S,
    variations=T.ArrayType(_struct(strategy=_S, preserve=_S)))))

SENTENCE_RESPONSE = _struct(sentences=T.ArrayType(_struct(seed_id=_L, plan_id=_I, text=_S)))

SENTIMENT_RESPONSE = _struct(evaluations=T.ArrayType(_struct(
    idx=_I, classifier_assessment=_S, semantic_analysis=_S, verdict=_S, reason=_S)))

LANGUAGE_RESPONSE = _struct(evaluations=T.ArrayType(_struct(
    idx=_I, naturalness=_S, issues=_S, verdict=_S, reason=_S)))

_CLASS = _struct(precision=_D, recall=_D, f1=_D, support=_L)

RUN = _struct(
    train_f1=_D, val_f1=_D, test_f1=_D, train_accuracy=_D, val_accuracy=_D, test_accuracy=_D,
    gap=_D, stop_epoch=_I, best_epoch=_I, per_class_test=T.MapType(_S, _CLASS),
    confusion_matrix_test=T.ArrayType(T.ArrayType(_I)), label_order=T.ArrayType(_S))

RESULTS = _struct(hyperparams=T.MapType(_S, _S), results=T.MapType(_S, RUN))

HISTORY_RECORD = _struct(epoch=_D, loss=_D, eval_loss=_D, eval_f1=_D, eval_accuracy=_D)

PREDICTION = _struct(
    model=_S, seed=_I, lang=_S, split=_S, example_id=_L, true_label=_S, logits=T.ArrayType(_D))
