"""Prompts, chunks, annotations, file names, softmax."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relrank.checks.registry import DOC_TEXT, check, clean
from relrank.checks.sampling import TRIPLES
from relrank.functions import logits as lg
from relrank.functions import text as t
from relrank.operators.sampling import make_triples, pair_prompts
from relrank.sources import tables


def chunk(expression: str, size: int = t.CHUNK_SIZE) -> str:
    """SQL of the first chunk for texts that do not start with white space."""
    cuts = [
        f"nullif(regexp_extract(substr({expression}, 1, {size + width}), '(?s)^(.+){pattern}', 1), '')"
        for pattern, width in ((r"\n\n", 2), (r"\n", 1), (r"\.", 1), ("!", 1), (r"\?", 1), (",", 1), (" ", 1))
    ]
    longer = f"coalesce({', '.join(cuts)}, substr({expression}, 1, {size}))"
    return clean(f"case when length({expression}) <= {size} then {expression} else {longer} end")


@check("select qid, concat('Query:', query, chr(10), 'Document:', doc) as prompt from v_turns")
def point_prompt(spark: SparkSession, d: str) -> DataFrame:
    return tables.turns(spark, d).select("qid", t.point_prompt("query", "doc").alias("prompt"))


@check(f"select docid, {DOC_TEXT} as doc from v_docs")
def doc_text(spark: SparkSession, d: str) -> DataFrame:
    return tables.docs(spark, d).select("docid", t.doc_text("title", "body").alias("doc"))


@check(
    """select qid, concat('Query:', query, chr(10), 'Document 1:', query, chr(10), 'Docuemt 2:', doc) train,
    concat('Query: ', query, chr(10), 'Document 1: ', query, chr(10), 'Document 2: ', doc) score from v_turns"""
)
def pair_prompt(spark: SparkSession, d: str) -> DataFrame:
    return tables.turns(spark, d).select(
        "qid",
        t.pair_prompt("query", "query", "doc", "train").alias("train"),
        t.pair_prompt("query", "query", "doc", "score").alias("score"),
    )


@check(f"select docid, {chunk('body')} as chunk, {chunk('body', 200)} as short from v_docs")
def first_chunk(spark: SparkSession, d: str) -> DataFrame:
    return tables.docs(spark, d).select(
        "docid", t.first_chunk("body").alias("chunk"), t.first_chunk("body", 200).alias("short")
    )


@check(
    """select concat('Query:', q, chr(10), 'Document 1:', p, chr(10), 'Docuemt 2:', n) as text, 1 as label from chunked
    union all
    select concat('Query:', q, chr(10), 'Document 1:', n, chr(10), 'Docuemt 2:', p), 0 from chunked""",
    ctes=TRIPLES
    + f", chunked as (select {chunk('query')} q, {chunk('p_body')} p, {chunk('n_body')} n from triples)",
)
def pair_prompts_of_triples(spark: SparkSession, d: str) -> DataFrame:
    return pair_prompts(
        make_triples(tables.run(spark, d), tables.queries(spark, d), tables.qrels(spark, d), tables.docs(spark, d))
    )


@check("select doc_id, quality as relevance, toxic as annotation from labels")
def parse_annotation(spark: SparkSession, d: str) -> DataFrame:
    mapped = tables.table(spark, d, "labels").select("doc_id", F.concat_ws(" , ", "quality", "toxic").alias("mapped"))
    relevance, annotation = t.parse_annotation("mapped")
    return mapped.select("doc_id", relevance.alias("relevance"), annotation.alias("annotation"))


@check("select page_id, lower(trim(split_part(split_part(rtrim(url, '/'), '/', -1), '.', 1))) as stem from pages")
def file_stem(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "pages").select("page_id", t.file_stem("url").alias("stem"))


@check(
    """select qid, docid, round(exp(logit0 - m) / (exp(logit0 - m) + exp(logit1 - m)), 6) p0,
      round(exp(logit1 - m) / (exp(logit0 - m) + exp(logit1 - m)), 6) p1
    from (select *, greatest(logit0, logit1) m from v_logits)"""
)
def softmax(spark: SparkSession, d: str) -> DataFrame:
    p = lg.softmax("logits")
    return tables.logits(spark, d).select("qid", "docid", F.round(p[0], 6).alias("p0"), F.round(p[1], 6).alias("p1"))


@check(
    """select qid, docid, round(logit0 - m - ln(exp(logit0 - m) + exp(logit1 - m)), 6) l0,
      round(logit1 - m - ln(exp(logit0 - m) + exp(logit1 - m)), 6) l1
    from (select *, greatest(logit0, logit1) m from v_logits)"""
)
def log_softmax(spark: SparkSession, d: str) -> DataFrame:
    p = lg.log_softmax("logits")
    return tables.logits(spark, d).select("qid", "docid", F.round(p[0], 6).alias("l0"), F.round(p[1], 6).alias("l1"))
