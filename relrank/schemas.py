"""Schemas of the files and tables, and a column guard. Ids are always strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STR, INT, LONG, DBL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

QUERIES = struct(qid=STR, query=STR)
QRELS = struct(qid=STR, iter=STR, docid=STR, label=INT)
RUN = struct(qid=STR, iter=STR, docid=STR, rank=INT, score=DBL, tag=STR)
DOCS = struct(docid=STR, url=STR, title=STR, body=STR)
PAIRS = struct(qid=STR, docid=STR, query=STR, doc=STR)
MAPPED_RUN = struct(qid=STR, docid=STR, query=STR, doc=STR, rank=INT, relevance=DBL)
MAPPED_TOP = struct(qid=STR, docid=STR, query=STR, doc_content=STR, rank=INT, score=DBL)
LABELLED_PAIRS = struct(qid=STR, docid=STR, query=STR, doc=STR, relevance=INT)
TRIPLES = struct(
    qid=STR, query=STR,
    p_docid=STR, p_url=STR, p_title=STR, p_body=STR,
    n_docid=STR, n_url=STR, n_title=STR, n_body=STR,
)
PROMPTS = struct(text=STR, label=INT)
FAIR = struct(qid=STR, docid=STR, query=STR, doc=STR, relevance=INT, annotation=INT)
SCORED = struct(qid=STR, docid=STR, rank=INT, score=DBL, prediction=INT)
SCORED_FAIR = struct(qid=STR, query=STR, docid=STR, rank=INT, score=DBL, prediction=INT, annotation=INT)
FAIR_JSON = T.MapType(STR, T.ArrayType(struct(docid=STR, title=STR, body=STR)))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df
