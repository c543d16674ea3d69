"""Filters, caps, joins to text, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relrank.checks.registry import DOC_TEXT, check, clean, stored_run
from relrank.operators import candidates as c
from relrank.operators.scoring import classify, rerank
from relrank.session import checkpoint
from relrank.sources import tables

MAPPED = f"""
mapped as (
  select r.qid, r.docid, {clean('q.query')} query, {clean(DOC_TEXT)} doc, r.rank, r.score run_score
  from v_run r join v_queries q on q.qid = r.qid join v_docs d on d.docid = r.docid)
"""


def fair_docs(spark: SparkSession, d: str) -> DataFrame:
    """All documents as fairness files would hold them, one file per source."""
    return tables.docs(spark, d).select(
        F.col("url").alias("stem"), F.concat(F.lit("topic "), F.col("url")).alias("query"), "docid", "title", "body"
    )


def fair_annotations(spark: SparkSession, d: str) -> DataFrame:
    return tables.fair(spark, d).select(
        F.col("qid").alias("stem"),
        "docid",
        F.concat_ws(",", "relevance", "annotation").alias("mapped_annotation"),
        F.lit(0).alias("pos"),
    )


@check("select qid, docid, label from v_qrels where label = 1")
def positives(spark: SparkSession, d: str) -> DataFrame:
    return c.positives(tables.qrels(spark, d)).select("qid", "docid", "label")


@check("select qid, docid, rank, score from v_run where rank <= 5")
def head_per_query(spark: SparkSession, d: str) -> DataFrame:
    return c.head_per_query(tables.run(spark, d), 5).select("qid", "docid", "rank", "score")


@check(
    """select qid, docid, rank from (
      select *, row_number() over (partition by qid, block order by line) nth from (
        select *, line - row_number() over (partition by qid order by line) block from (
          select *, row_number() over (order by rank > 50, qid, rank) line from v_run)))
    where nth <= 5"""
)
def head_per_query_runs(spark: SparkSession, d: str) -> DataFrame:
    """The run in file order with two blocks of lines per query: ranks up to 50, then the rest."""
    lines = stored_run(spark, d).withColumn("line", F.struct(F.col("rank") > 50, "qid", "rank"))
    return c.head_per_query(lines, 5, mode="runs").select("qid", "docid", "rank")


@check("select docid from v_run where rank <= 5 union select docid from v_qrels where label = 1")
def required_docs(spark: SparkSession, d: str) -> DataFrame:
    return c.required_docs(tables.run(spark, d), 5, c.positives(tables.qrels(spark, d)))


@check("select distinct qid from v_qrels")
def judged_queries(spark: SparkSession, d: str) -> DataFrame:
    return c.judged_queries(tables.qrels(spark, d))


@check("select qid, 'Q0' as run, docid, cast(relevance as int) as label from v_fair")
def to_qrels(spark: SparkSession, d: str) -> DataFrame:
    return c.to_qrels(tables.fair(spark, d))


@check("select qid, docid, label, docid as docno from v_qrels")
def with_docno(spark: SparkSession, d: str) -> DataFrame:
    return c.with_docno(tables.qrels(spark, d).select("qid", "docid", "label"))


@check(
    """select qid, docid, cast(row_number() over (partition by qid order by logit1 - logit0 desc, docid) as int) rank,
    logit1 - logit0 score, case when logit1 > logit0 then 1 else 0 end prediction from v_logits"""
)
def project_run(spark: SparkSession, d: str) -> DataFrame:
    return c.project_run(rerank(checkpoint(classify(tables.logits(spark, d)))))


@check(
    """select qid, query, docid, cast(row_number() over (partition by qid order by score desc, docid) as int) rank,
    score, prediction, annotation from v_fair"""
)
def project_run_fair(spark: SparkSession, d: str) -> DataFrame:
    return c.project_run(rerank(tables.fair(spark, d)), fair=True)


@check(
    """select qid, docid, rank from v_run where qid not in (
      select qid from (select distinct qid from v_run) order by qid limit 10)"""
)
def skip_queries(spark: SparkSession, d: str) -> DataFrame:
    return c.skip_queries(stored_run(spark, d), 10).select("qid", "docid", "rank")


@check("select * from mapped", ctes=MAPPED)
def map_run(spark: SparkSession, d: str) -> DataFrame:
    return c.map_run(tables.run(spark, d), tables.queries(spark, d), tables.docs(spark, d))


@check("select * from mapped where docid in (select docid from v_run where rank <= 5)", ctes=MAPPED)
def map_run_pruned(spark: SparkSession, d: str) -> DataFrame:
    return c.map_run(stored_run(spark, d), tables.queries(spark, d), tables.docs(spark, d), k=5)


@check(
    """select qid, docid, query, doc, rank, run_score as relevance from mapped
    where qid in (select qid from v_qrels)""",
    ctes=MAPPED,
)
def map_run_judged(spark: SparkSession, d: str) -> DataFrame:
    judged = c.judged_queries(tables.qrels(spark, d))
    mapped = c.map_run(tables.run(spark, d), tables.queries(spark, d), tables.docs(spark, d), only=judged)
    return c.mapped_run_file(mapped)


@check("select docid, url, title, body from v_docs where docid in (select docid from v_run where rank <= 5)")
def prune_docs(spark: SparkSession, d: str) -> DataFrame:
    return c.prune_docs(tables.docs(spark, d), c.required_docs(tables.run(spark, d), 5))


@check(
    """select count(*) filter (q.qid is not null and d.docid is not null) kept,
      count(*) filter (q.qid is null or d.docid is null) missing_data
    from v_run r left join v_queries q on q.qid = r.qid left join v_docs d on d.docid = r.docid"""
)
def map_stats(spark: SparkSession, d: str) -> DataFrame:
    return c.map_stats(tables.run(spark, d), tables.queries(spark, d), tables.docs(spark, d))


@check(f"select q.qid, q.docid, {clean('d.body')} doc from v_qrels q join v_docs d on d.docid = q.docid")
def fetch_docs(spark: SparkSession, d: str) -> DataFrame:
    return c.fetch_docs(tables.qrels(spark, d).select("qid", "docid"), tables.docs(spark, d))


@check(
    f"""select r.qid, r.docid, {clean('q.query')} query, {clean('d.body')} doc_content, r.rank, r.score
    from v_run r join v_queries q on q.qid = r.qid join v_docs d on d.docid = r.docid where r.rank <= 10"""
)
def map_top_k(spark: SparkSession, d: str) -> DataFrame:
    return c.map_top_k(tables.run(spark, d), tables.queries(spark, d), tables.docs(spark, d))


@check(
    f"""select cast(n.n as varchar) qid, d.docid, concat('topic ', d.url) query, {DOC_TEXT} doc,
      f.relevance, f.annotation
    from v_docs d join v_fair f on f.docid = d.docid
    join (select url, row_number() over (order by url) n from (select distinct url from v_docs)) n on n.url = d.url"""
)
def build_fair(spark: SparkSession, d: str) -> DataFrame:
    return c.build_fair(fair_docs(spark, d), fair_annotations(spark, d))


@check("select count(*) as unannotated from v_docs where docid not in (select docid from v_fair)")
def unannotated(spark: SparkSession, d: str) -> DataFrame:
    return c.unannotated(fair_docs(spark, d), fair_annotations(spark, d))


@check(
    """select cast(row_number() over (order by url) as varchar) qid, url as stem
    from (select distinct url from v_docs)"""
)
def assign_qids(spark: SparkSession, d: str) -> DataFrame:
    return c.assign_qids(fair_docs(spark, d))


@check(
    """select r.qid, r.docid, r.rank, coalesce(j.label, 0) label
    from v_run r left join v_qrels j on j.qid = r.qid and j.docid = r.docid"""
)
def join_qrels(spark: SparkSession, d: str) -> DataFrame:
    run = tables.run(spark, d).select("qid", "docid", "rank")
    return c.join_qrels(run, tables.qrels(spark, d))


@check(
    """select a.qid, cast(a.rank - 1 as int) pos_a, a.docid docid_a, cast(b.rank - 1 as int) pos_b, b.docid docid_b
    from v_run a join v_run b on a.qid = b.qid and a.rank < b.rank where a.rank <= 10 and b.rank <= 10"""
)
def pair_candidates(spark: SparkSession, d: str) -> DataFrame:
    return c.pair_candidates(tables.run(spark, d), 10)


@check(
    """select qid, docid, label from v_qrels where label = 1 union all
    select qid, docid, cast(relevance as int) from v_fair"""
)
def union_aligned(spark: SparkSession, d: str) -> DataFrame:
    judged = c.positives(tables.qrels(spark, d)).select("qid", "docid", "label")
    fair = c.to_qrels(tables.fair(spark, d)).select("label", "docid", "qid")
    return c.union_aligned(judged, fair)


@check("select qid, query from v_queries where qid not in (select qid from v_qrels)")
def minus(spark: SparkSession, d: str) -> DataFrame:
    return c.minus(tables.queries(spark, d), tables.qrels(spark, d), ["qid"])


@check("select docid from v_run union select docid from v_fair")
def union_ids(spark: SparkSession, d: str) -> DataFrame:
    return c.union_ids(tables.run(spark, d), tables.fair(spark, d))


@check("select qid, docid from v_qrels intersect select qid, docid from v_run")
def common_ids(spark: SparkSession, d: str) -> DataFrame:
    return c.common_ids(tables.qrels(spark, d), tables.run(spark, d))
