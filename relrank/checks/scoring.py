"""Scoring, re-ranking, pairwise ranking."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relrank.checks.candidates import MAPPED
from relrank.checks.registry import check, hash_number, new_path, stored_run, words
from relrank.checks.text import chunk
from relrank.functions import logits as lg
from relrank.functions.text import point_prompt
from relrank.operators import pairwise as p
from relrank.operators import scoring as sc
from relrank.operators.candidates import head_per_query, map_run
from relrank.operators.sampling import split_train_test
from relrank.operators.scoring import text_shape
from relrank.plans.flows import evaluate_pairwise, rerank_run, score_and_rerank, submit_pairwise, train
from relrank.session import checkpoint
from relrank.sources import tables

LOGITS = MAPPED + f"""
, scored as (
  select qid, docid, rank, n - found logit0, found logit1 from (
    select qid, docid, rank, cast(len({words('query')}) as double) n,
      cast(len(list_intersect({words('query')}, {words('doc')})) as double) found from mapped))
"""

PAIRS = MAPPED + f"""
, short as (select qid, docid, rank - 1 pos, {chunk('query')} query, {chunk('doc')} doc from mapped where rank <= 10),
found as (
  select qid, docid, pos, cast(len(list_intersect({words('query')}, {words('doc')})) as double) found from short),
pairs as (
  select a.qid, cast(a.pos as int) pos_a, a.docid docid_a, cast(b.pos as int) pos_b, b.docid docid_b,
    b.found logit0, a.found logit1
  from found a join found b on a.qid = b.qid and a.pos < b.pos),
sides as (
  select qid, docid_a docid, case when logit1 > logit0 then 1 else 0 end won, logit1 logit from pairs union all
  select qid, docid_b, case when logit1 > logit0 then 0 else 1 end, logit0 from pairs),
by_document as (
  select f.qid, f.docid, cast(f.pos as int) pos, cast(coalesce(sum(s.won), 0) as bigint) wins, sum(s.logit) logit
  from found f left join sides s on s.qid = f.qid and s.docid = f.docid group by f.qid, f.docid, f.pos)
"""

RERANKED = """select qid, docid, cast(row_number() over (partition by qid order by logit1 - logit0 desc, docid) as int) rank,
logit1 - logit0 score, case when logit1 > logit0 then 1 else 0 end prediction from scored"""


def inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tables.run(spark, d), tables.queries(spark, d), tables.docs(spark, d)


def top_pairs(spark: SparkSession, d: str, run: DataFrame | None = None) -> DataFrame:
    """The compared pairs of the first ten documents of each query."""
    given, queries, docs = inputs(spark, d)
    run = given if run is None else run
    return p.score_doc_pairs(map_run(head_per_query(run, 10), queries, docs))


def two_columns(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c != "logits"]
    return df.select(*keep, lg.logit("logits", 0).alias("logit0"), lg.logit("logits", 1).alias("logit1"))


@check("select * from scored", ctes=LOGITS)
def score_run(spark: SparkSession, d: str) -> DataFrame:
    return two_columns(sc.score_run(*inputs(spark, d)).select("qid", "docid", "rank", "logits"))


@check(
    f"""select qid, query, docid, relevance, n - found logit0, found logit1 from (
      select *, cast(len({words('query')}) as double) n,
        cast(len(list_intersect({words('query')}, {words('doc')})) as double) found from v_fair)"""
)
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    return two_columns(sc.score_pairs(tables.fair(spark, d)).select("qid", "query", "docid", "relevance", "logits"))


@check("select * from scored", ctes=LOGITS)
def score_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A Python model on batches of prompts, as an external one is plugged in; here it counts shared words."""

    def load():
        word = re.compile("[a-z]{4,}")

        def count(prompt: str) -> tuple[int, int]:
            query, doc = prompt.removeprefix("Query:").split("\nDocument:", 1)
            wanted = set(word.findall(query.lower()))
            found = len(wanted & set(word.findall(doc.lower())))
            return len(wanted) - found, found

        return lambda prompts: np.array([count(p) for p in prompts], dtype="float64")

    scored = sc.score_pairs(map_run(*inputs(spark, d)), sc.PromptScorer(load))
    return two_columns(scored.select("qid", "docid", "rank", "logits"))


@check("select qid, docid, case when logit1 > logit0 then 1 else 0 end as prediction from v_logits")
def predict(spark: SparkSession, d: str) -> DataFrame:
    return tables.logits(spark, d).select("qid", "docid", lg.predict("logits").alias("prediction"))


@check("select qid, docid, logit1 as absolute, logit1 - logit0 as relative from v_logits")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return tables.logits(spark, d).select(
        "qid",
        "docid",
        lg.relevance_score("logits", 0).alias("absolute"),
        lg.relevance_score("logits", 1).alias("relative"),
    )


@check(RERANKED, ctes=LOGITS)
def rerank(spark: SparkSession, d: str) -> DataFrame:
    return rerank_run(*inputs(spark, d))


@check(
    f"""select qid, query, docid, cast(row_number() over (partition by qid order by score desc, docid) as int) rank,
      score, prediction, annotation from (
      select qid, query, docid, annotation, 2 * found - n score, case when 2 * found > n then 1 else 0 end prediction
      from (select *, cast(len({words('query')}) as double) n,
        cast(len(list_intersect({words('query')}, {words('doc')})) as double) found from v_fair))"""
)
def rerank_fair(spark: SparkSession, d: str) -> DataFrame:
    return score_and_rerank(tables.fair(spark, d), fair=True)


@check("select * from pairs", ctes=PAIRS)
def score_doc_pairs(spark: SparkSession, d: str) -> DataFrame:
    return two_columns(top_pairs(spark, d))


@check(
    """select qid, docid, pos, wins, cast(row_number() over (partition by qid order by wins desc, pos) as int) rank
    from by_document""",
    ctes=PAIRS,
)
def rank_by_wins(spark: SparkSession, d: str) -> DataFrame:
    run = stored_run(spark, d)
    return p.rank_by_wins(head_per_query(run, 10), top_pairs(spark, d, run))


@check(
    """select qid, docid, wins, round_even(w / sum(w) over (partition by qid), 2) probability from (
      select *, exp(wins - max(wins) over (partition by qid)) w from by_document)""",
    ctes=PAIRS,
)
def win_probability(spark: SparkSession, d: str) -> DataFrame:
    run = stored_run(spark, d)
    wins = p.rank_by_wins(head_per_query(run, 10), top_pairs(spark, d, run))
    return p.win_probability(wins).select("qid", "docid", "wins", "probability")


@check(
    """select qid, docid, pos, round(score, 6) score,
      cast(row_number() over (partition by qid order by score desc nulls last, pos) as int) rank from (
      select qid, docid, pos, logit / nullif(count(*) over (partition by qid) - 1, 0) score from by_document)""",
    ctes=PAIRS,
)
def rank_by_mean_logit(spark: SparkSession, d: str) -> DataFrame:
    run = stored_run(spark, d)
    ranked = p.rank_by_mean_logit(head_per_query(run, 10), top_pairs(spark, d, run))
    return ranked.withColumn("score", F.round("score", 6))


def top_mapped(spark: SparkSession, d: str) -> DataFrame:
    """The first ten documents of each query with their texts and the score of the run."""
    run, queries, docs = inputs(spark, d)
    return checkpoint(map_run(head_per_query(run, 10), queries, docs).withColumnRenamed("run_score", "score"))


@check(
    """select qid, round(sum(mean_gain / log2(rnk + 1)) / sum(gain / log2(best + 1)), 6) as value from (
      select qid, gain, avg(gain) over (partition by qid, probability) mean_gain,
        row_number() over (partition by qid order by probability desc) rnk,
        row_number() over (partition by qid order by gain desc) best from (
        select b.qid, 10 + m.run_score gain, round_even(b.w / sum(b.w) over (partition by b.qid), 2) probability
        from (select *, exp(wins - max(wins) over (partition by qid)) w from by_document) b
        join mapped m on m.qid = b.qid and m.docid = b.docid)) group by qid""",
    ctes=PAIRS,
)
def pairwise_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return evaluate_pairwise(top_mapped(spark, d)).select("qid", F.round("value", 6).alias("value"))


@check(
    """select printf('%s, Q0, %s, %d, %.4f, %s', qid, docid, rank, score, 'pairwise') as value from (
      select *, row_number() over (partition by qid order by score desc, pos) rank from (
        select qid, docid, pos, logit / nullif(count(*) over (partition by qid) - 1, 0) score from by_document))
    where score is not null""",
    ctes=PAIRS,
)
def pairwise_submission(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "run.txt")
    submit_pairwise(top_mapped(spark, d), "pairwise", path)
    return spark.read.text(path)


@check()
def fit_pair_scorer(spark: SparkSession, d: str) -> DataFrame:
    """Metrics, on a held-out fifth, of a classifier trained on all labelled documents."""
    prompts = tables.fair(spark, d).select(
        point_prompt("query", "doc").alias("text"), F.col("relevance").alias("label")
    )
    return train(prompts).metrics


def _newton_sql(steps: int, penalty: float) -> str:
    """Newton steps of a constant and one weight, as CTEs w0, w1, ...; the solution of two equations is written out."""
    ctes = ["w0 as (select 0.0::double a, 0.0::double b)"]
    for k in range(steps):
        ctes.append(
            f"""w{k + 1} as (select a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) b from (
      select any_value(a) a, any_value(b) b, sum(y - p) ga, sum((y - p) * x) - {penalty} * any_value(b) gb, sum(p * (1 - p)) haa,
        sum(p * (1 - p) * x) hab, sum(p * (1 - p) * x * x) + {penalty} hbb
      from (select *, 1 / (1 + exp(-(a + b * x))) p from shaped cross join w{k} where part = 'train')))"""
        )
    return ",\n".join(ctes)


SHAPED = f"""
shaped as (
  select cast(relevance as double) y, length(regexp_replace(lower(coalesce(doc, '')), '[^a-z]', '', 'g')) / greatest(length(coalesce(doc, '')), 1) x,
    case when {hash_number('docid')} < 858993459 then 'test' else 'train' end part from v_fair),
{_newton_sql(6, 0.1)}
"""


@check(
    """select round(any_value(a), 5) as bias, round(any_value(b), 5) as weight, avg(cast((a + b * x > 0) = (y = 1) as int)) as accuracy,
      greatest(avg(y), 1 - avg(y)) as majority
    from shaped cross join w6 where part = 'test'""",
    ctes=SHAPED,
)
def fit_logistic(spark: SparkSession, d: str) -> DataFrame:
    """A classifier of the labelled documents by their share of letters: its weights after six steps, and its accuracy on a
    held-out fifth next to that of a constant answer."""
    rows = tables.fair(spark, d).select("docid", F.col("doc").alias("text"), F.col("relevance").alias("label"))
    parts = checkpoint(split_train_test(rows, ["docid"], exact=False))
    scorer = sc.fit_logistic(parts.where("part = 'train'"), lambda text: text_shape(text)[:1])
    scored = scorer.texts(parts.where("part = 'test'")).withColumn("right", (lg.predict("logits") == F.col("label")).cast("int"))
    share = F.avg(F.col("label").cast("double"))
    return scored.agg(F.avg("right").alias("accuracy"), F.greatest(share, 1 - share).alias("majority")).select(
        *[F.lit(round(w, 5)).alias(n) for n, w in zip(("bias", "weight"), scorer.weights)], "accuracy", "majority"
    )
