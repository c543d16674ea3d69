"""Files: each view is written in its file format into the shared folder and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relrank import schemas
from relrank.checks.registry import check, new_path
from relrank.checks.sampling import TRIPLES
from relrank.functions.text import point_prompt
from relrank.operators.candidates import build_fair
from relrank.operators.sampling import make_triples
from relrank.operators.scoring import PromptScorer, classify, rerank
from relrank.plans import flows
from relrank.session import checkpoint
from relrank.sources import readers, tables, writers


def one_line(column: str) -> Column:
    return F.regexp_replace(column, r"[\t\n\r]+", " ")


@check("select qid, query from v_queries")
def read_queries(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "queries.tsv")
    writers.write_tsv(tables.queries(spark, d), path, header=False)
    return readers.read_queries(spark, path, multi_line=True)


@check("select qid, iter, docid, label from v_qrels")
def read_qrels(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "qrels.txt")
    writers.write_qrels(tables.qrels(spark, d), path)
    return readers.read_qrels(spark, path)


@check("select qid, iter, docid, rank, score, tag from v_run")
def read_run(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "run.txt")
    lines = tables.run(spark, d).select(F.concat_ws(" ", "qid", "iter", "docid", "rank", "score", "tag").alias("value"))
    lines.write.text(path)
    return readers.read_run(spark, path)


@check(
    r"""select docid, url, regexp_replace(title, '[\t\n\r]+', ' ', 'g') title,
    regexp_replace(body, '[\t\n\r]+', ' ', 'g') body from v_docs"""
)
def read_docs(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "docs.tsv")
    fields = F.concat_ws("\t", "docid", "url", one_line("title"), one_line("body"))
    tables.docs(spark, d).select(fields.alias("value")).write.text(path)
    return readers.read_docs(spark, path)


@check(
    r"""select docid, url, regexp_replace(title, '[\t\n\r]+', ' ', 'g') title,
    regexp_replace(body, '[\t\n\r]+', ' ', 'g') body from v_docs"""
)
def read_docs_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Every docid stands in the collection twice; the last line counts, which is the right one."""
    path = new_path(spark, "docs.tsv")
    docs = tables.docs(spark, d)
    both = docs.withColumns({"body": F.lit("early"), "turn": F.lit(0)}).unionByName(docs.withColumn("turn", F.lit(1)))
    fields = F.concat_ws("\t", "docid", "url", one_line("title"), one_line("body"))
    both.repartition("docid").sortWithinPartitions("turn").select(fields.alias("value")).write.text(path)
    return readers.read_docs(spark, path)


@check("select docid, url, title, body from v_docs")
def read_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "docs.tsv")
    writers.write_tsv(tables.docs(spark, d), path)
    return readers.read_tsv(spark, path, schemas.DOCS, multi_line=True)


@check("select qid, docid, query, doc, relevance, annotation from v_fair")
def read_tsv_without_index(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "fair.tsv")
    indexed = tables.fair(spark, d).select(F.lit(0).alias("Unnamed: 0"), *reversed(schemas.FAIR.names))
    writers.write_tsv(indexed, path)
    return readers.read_tsv(spark, path, schemas.FAIR, multi_line=True)


@check("select qid, query, doc from v_turns")
def read_tsv_headerless(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "turns.tsv")
    writers.write_tsv(tables.turns(spark, d), path, header=False)
    return readers.read_tsv(
        spark, path, schemas.struct(qid=schemas.STR, query=schemas.STR, doc=schemas.STR), header=False, multi_line=True
    )


@check("select concat_ws(' ', qid, 'Q0', docid, cast(label as varchar)) as value from v_qrels")
def write_qrels(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "qrels.txt")
    writers.write_qrels(tables.qrels(spark, d), path)
    return spark.read.text(path)


@check(
    """select printf('%s, Q0, %s, %d, %.4f, %s', qid, docid, rank, score, 'lexical') as value from (
    select qid, docid, logit1 - logit0 score,
      row_number() over (partition by qid order by logit1 - logit0 desc, docid) rank from v_logits)"""
)
def write_run(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "run.txt")
    writers.write_run(rerank(checkpoint(classify(tables.logits(spark, d)))), "lexical", path)
    return spark.read.text(path)


@check("select * from triples", ctes=TRIPLES)
def write_triples(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "triples.tsv")
    triples = make_triples(tables.run(spark, d), tables.queries(spark, d), tables.qrels(spark, d), tables.docs(spark, d))
    writers.write_triples(triples, path)
    return readers.read_tsv(spark, path, schemas.TRIPLES, header=False, multi_line=True)


TOPICS = """
topics as (
  select d.source folder, concat(d.source, '-', d.doc_id // 500) stem, concat('topic ', d.source, ' ', d.doc_id // 500) query,
    concat('D', d.doc_id) docid, split_part(d.text, chr(10), 1) title, d.text body, l.quality relevance, l.toxic annotation
  from documents d join labels l on l.doc_id = d.doc_id),
dataset as (
  select cast(dense_rank() over (order by stem) as varchar) qid, docid, query,
    concat('Title: ', coalesce(title, ''), ', Context: ', coalesce(body, '')) doc, cast(relevance as int) relevance,
    cast(annotation as int) annotation
  from topics)
"""


def fair_folders(spark: SparkSession, d: str) -> str:
    """The labelled documents as fairness folders, a topic for every 500 ids of a source. Every document has two
    annotations, of which the first in the file is the right one."""
    rows = tables.table(spark, d, "documents").join(tables.table(spark, d, "labels"), "doc_id")
    block = F.floor(F.col("doc_id") / 500).cast("string")
    topic = rows.select(
        F.col("source").alias("folder"), F.concat_ws("-", "source", block).alias("stem"), F.concat_ws(" ", F.lit("topic"), "source", block).alias("query"),
        F.concat(F.lit("D"), "doc_id").alias("docid"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"),
        "quality", "toxic", "doc_id",
    )
    notes = topic.select("folder", "stem", "docid", F.concat_ws(",", "quality", "toxic").alias("mapped_annotation"), F.struct(F.lit(0), "doc_id").alias("pos"))
    wrong = notes.withColumns({"mapped_annotation": F.lit("7,7"), "pos": F.struct(F.lit(1), "pos.doc_id")})
    root = new_path(spark, "tree")
    writers.write_fair_tree(topic, notes.unionByName(wrong), root)
    return root


@check("select qid, docid, query, doc, relevance, annotation from dataset", ctes=TOPICS)
def read_fair_tree(spark: SparkSession, d: str) -> DataFrame:
    return build_fair(*readers.read_fair_tree(spark, fair_folders(spark, d)))


@check("select qid, docid, query, doc, relevance, annotation from dataset", ctes=TOPICS)
def fair_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Folders, data set file, and back."""
    return flows.fair_dataset(spark, fair_folders(spark, d), new_path(spark, "fair.tsv"), new_path(spark, "qrels.txt"))


@check("select concat_ws(' ', qid, 'Q0', docid, relevance) as value from dataset", ctes=TOPICS)
def fair_dataset_qrels(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "qrels.txt")
    flows.fair_dataset(spark, fair_folders(spark, d), new_path(spark, "fair.tsv"), path)
    return spark.read.text(path)


@check(
    f"""select tn, fp, fn, tp, (tn + tp) / (tn + fp + fn + tp) as accuracy, tp / nullif(tp + fp, 0) as "precision", tp / nullif(tp + fn, 0) as recall,
      2 * tp / nullif(2 * tp + fp + fn, 0) as f1, loss from (
      select count(*) filter (y = 0 and p = 0) tn, count(*) filter (y = 0 and p = 1) fp, count(*) filter (y = 1 and p = 0) fn,
        count(*) filter (y = 1 and p = 1) tp, round(avg(ln(exp(l0) + exp(l1)) - case when y = 1 then l1 else l0 end), 6) loss from (
        select y, l0, l1, case when l1 > l0 then 1 else 0 end p from (
          select relevance y, 2.0 l0, cast(length(concat('Query:', query, chr(10), 'Document:', doc)) % 5 as double) l1 from v_fair)))"""
)
def evaluate_classifier(spark: SparkSession, d: str) -> DataFrame:
    """A model on a labelled prompt file: its second logit is the length of the prompt modulo 5."""
    path = new_path(spark, "prompts.tsv")
    prompts = tables.fair(spark, d).select(point_prompt("query", "doc").alias("text"), F.col("relevance").alias("label"))
    writers.write_tsv(prompts, path)
    scorer = PromptScorer(lambda: lambda texts: np.array([(2.0, len(t) % 5) for t in texts]))
    found = flows.evaluate_classifier(spark, path, scorer)
    return found.withColumn("loss", F.round("loss", 6))
