"""Explicit schemas of the tables that enter and leave the library."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STR, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

TRIPLE = _schema(subjectLabel=STR, relation=STR, objectLabel=STR)
MISSED = _schema(source=STR, subjectLabel=STR, relation=STR, objectLabel=STR, reason=STR)
QA = _schema(
    source=STR, question=STR, answer=STR, subjectLabel=STR, relation=STR, objectLabel=STR,
    subject_qid=STR, object_qid=STR,
    subject_sitelinks=INT, subject_identifiers=INT, object_sitelinks=INT, object_identifiers=INT,
    subject_popularity=INT, object_popularity=INT, popularity_sum=INT,
)
ENTITY_LABEL = _schema(label=STR, qid=STR)
ENTITY_POPULARITY = _schema(qid=STR, sitelinks=INT, identifiers=INT)
RELATION_TAGS = _schema(relation=STR, tokens=T.ArrayType(STR), tags=T.ArrayType(STR), lemmas=T.ArrayType(STR))
OBJECT_TAGS = _schema(object=STR, ner1=STR, ner2=STR)
METRIC_AGG = _schema(run=STR, metric=STR, agg_value=DOUBLE)
FEW_SHOT = _schema(question=STR, answer=STR)
ALTERNATE = _schema(question=STR, answer=STR, alternate=STR)
SWEEP = _schema(run_id=STR, learning_rate=DOUBLE, train_loss=DOUBLE, rouge=DOUBLE)
RUN_SUMMARY = T.MapType(STR, DOUBLE)
