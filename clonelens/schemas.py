"""Explicit schemas of the relations (no inference on read)."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _d = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Clone metadata: every value is text, as the extraction emits it.
CLONES = _schema(FUNCTION_ID_ONE=_s, FUNCTION_ID_TWO=_s, SYNTACTIC_TYPE=_s, SIMILARITY_LINE=_s, SIMILARITY_TOKEN=_s)
FUNCTIONS = _schema(idx=_s, func=_s)
UNIFIED = _schema(id1=_s, id2=_s, func1=_s, func2=_s, label=_i, clone_type=_s)
BALANCED = _schema(func1=_s, func2=_s, clone_type=_s)
SCORED = _schema(
    split=_s, row_id=_l, clone_type=_s, binary_target=_s, tokens_func1=_l, tokens_func2=_l, shared_token_overlap=_l,
    overlap_similarity=_d, jaccard_similarity=_d, containment_1_in_2=_d, containment_2_in_1=_d, prediction=_s,
)
