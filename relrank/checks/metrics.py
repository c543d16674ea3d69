"""Ranking metrics, classification metrics, annotation mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relrank.checks.registry import check, hashed, stored_run
from relrank.operators import classification as cl
from relrank.operators import fairness as fa
from relrank.operators import metrics as m
from relrank.operators.candidates import join_qrels
from relrank.operators.scoring import rerank
from relrank.session import checkpoint
from relrank.sources import tables

RANKED = """
ranked as (
  select r.qid, r.docid, r.score, coalesce(j.label, 0) label,
    row_number() over (partition by r.qid order by r.score desc, r.docid desc) rnk
  from v_run r left join v_qrels j on j.qid = r.qid and j.docid = r.docid),
hits as (
  select *, sum(case when label >= 1 then 1 else 0 end) over (partition by qid order by rnk) hits,
    sum(case when label >= 2 then 1 else 0 end) over (partition by qid order by rnk) hits2 from ranked),
ideal as (select qid, label, row_number() over (partition by qid order by label desc) rnk from v_qrels),
judged as (
  select qid, count(*) filter (label >= 1) relevant, count(*) filter (label >= 2) relevant2,
    sum(label / log2(rnk + 1)) filter (rnk <= 1) i1, sum(label / log2(rnk + 1)) filter (rnk <= 5) i5,
    sum(label / log2(rnk + 1)) filter (rnk <= 10) i10, sum(label / log2(rnk + 1)) filter (rnk <= 100) i100
  from ideal group by qid),
sums as (
  select qid, count(*) filter (label >= 1 and rnk <= 10) / cast(10 as double) p10,
    count(*) filter (label >= 1 and rnk <= 1000) found,
    coalesce(sum(hits / rnk) filter (label >= 1), 0) ap, coalesce(sum(hits / rnk) filter (label >= 1 and rnk <= 10), 0) ap10,
    coalesce(sum(hits2 / rnk) filter (label >= 2 and rnk <= 100), 0) ap2,
    sum(label / log2(rnk + 1)) filter (rnk <= 1) g1, sum(label / log2(rnk + 1)) filter (rnk <= 5) g5,
    sum(label / log2(rnk + 1)) filter (rnk <= 10) g10, sum(label / log2(rnk + 1)) filter (rnk <= 100) g100
  from hits group by qid),
values_ as (
  select s.qid, p10, coalesce(found / nullif(relevant, 0), 0) recall, coalesce(ap / nullif(relevant, 0), 0) ap,
    coalesce(ap10 / nullif(relevant, 0), 0) ap10, coalesce(ap2 / nullif(relevant2, 0), 0) ap2,
    coalesce(g1 / nullif(i1, 0), 0) n1, coalesce(g5 / nullif(i5, 0), 0) n5,
    coalesce(g10 / nullif(i10, 0), 0) n10, coalesce(g100 / nullif(i100, 0), 0) n100
  from sums s left join judged j on j.qid = s.qid)
"""

# Predictions of the run against the judged documents as sets.
SETS = """
truth as (select distinct qid, docid from v_qrels),
set_hits as (
  select r.qid, r.rank, j.docid is not null hit,
    count(j.docid) over (partition by r.qid order by r.rank) found
  from v_run r left join truth j on j.qid = r.qid and j.docid = r.docid),
set_values as (
  select t.qid, count(distinct t.docid) relevant from truth t group by t.qid)
"""


def judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tables.run(spark, d), tables.qrels(spark, d)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns or ("value",):
        df = df.withColumn(column, F.round(column, 6))
    return df


def per_query(sql_column: str):
    return check(f"select qid, round({sql_column}, 6) as value from values_", ctes=RANKED)


@per_query("p10")
def precision_at_10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.precision_at(*judged(spark, d), k=10))


@per_query("recall")
def recall_at_1000(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.recall_at(*judged(spark, d), k=1000))


DEEP = """
deep as (
  select qid, docid, row_number() over (partition by qid order by score desc, docid desc) rnk from (
    select q.qid, d.docid, count(*) score from v_qtok q join v_dtok d on q.w = d.w group by q.qid, d.docid)),
relevant as (select qid, count(*) n from (select qid, docid, max(label) label from v_qrels group by qid, docid) where label >= 1 group by qid),
found as (
  select d.qid, count(j.docid) filter (rnk <= 20) at_20, count(j.docid) filter (rnk <= 1000) at_1000
  from deep d left join (select distinct qid, docid from v_qrels where label >= 1) j on j.qid = d.qid and j.docid = d.docid
  where rnk <= 2000 group by d.qid)
"""


@check(
    """select f.qid, round(coalesce(at_20 / nullif(n, 0), 0), 6) as recall_20, round(coalesce(at_1000 / nullif(n, 0), 0), 6) as recall_1000
    from found f left join relevant r on r.qid = f.qid""",
    ctes=DEEP,
)
def recall_of_a_deep_run(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 20 and at 1,000 of a run that goes down to 2,000 documents a query."""
    run, qrels = checkpoint(tables.run(spark, d, 2000)), checkpoint(tables.qrels(spark, d))
    at = {k: rounded(m.recall_at(run, qrels, k=k)).withColumnRenamed("value", f"recall_{k}") for k in (20, 1000)}
    return at[20].join(at[1000], "qid")


@per_query("ap")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.average_precision(stored_run(spark, d), tables.qrels(spark, d)))


@per_query("ap2")
def average_precision_of_grade_2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.average_precision(*judged(spark, d), min_rel=2, depth=100))


@per_query("n1")
def ndcg_at_1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.ndcg_at(*judged(spark, d), k=1))


@per_query("n5")
def ndcg_at_5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.ndcg_at(*judged(spark, d), k=5))


@per_query("n10")
def ndcg_at_10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.ndcg_at(*judged(spark, d), k=10))


@per_query("n100")
def ndcg_at_100(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.ndcg_at(*judged(spark, d), k=100))


@check(
    """select round(avg(coalesce(v.ap10, 0)), 6) mean from judged j left join values_ v on v.qid = j.qid""",
    ctes=RANKED,
)
def mean_ap_at_10(spark: SparkSession, d: str) -> DataFrame:
    run, qrels = judged(spark, d)
    return rounded(m.corpus_mean(m.average_precision(run, qrels, depth=10), qrels), "mean")


@check(
    """select round(avg(coalesce(v.ap2, 0)), 6) "AP(rel=2)@100", round(avg(coalesce(v.p10, 0)), 6) "precision@10",
      round(avg(coalesce(v.ap, 0)), 6) "map", round(avg(coalesce(v.n1, 0)), 6) "nDCG@1",
      round(avg(coalesce(v.n5, 0)), 6) "nDCG@5", round(avg(coalesce(v.n10, 0)), 6) "nDCG@10",
      round(avg(coalesce(v.n100, 0)), 6) "nDCG@100"
    from judged j left join values_ v on v.qid = j.qid""",
    ctes=RANKED,
)
def evaluate(spark: SparkSession, d: str) -> DataFrame:
    result = m.evaluate(*judged(spark, d))
    return rounded(result, *result.columns)


@check(
    """select round(avg(ap2), 6) "AP(rel=2)@100", round(avg(p10), 6) "precision@10", round(avg(ap), 6) "map",
      round(avg(n1), 6) "nDCG@1", round(avg(n5), 6) "nDCG@5", round(avg(n10), 6) "nDCG@10",
      round(avg(n100), 6) "nDCG@100" from values_""",
    ctes=RANKED,
)
def evaluate_run_queries(spark: SparkSession, d: str) -> DataFrame:
    result = m.evaluate(*judged(spark, d), denominator="run")
    return rounded(result, *result.columns)


@check(
    """select v.qid, q.query, round(p10, 6) "precision@10", round(ap, 6) "map", round(n1, 6) "nDCG@1",
      round(n5, 6) "nDCG@5", round(n10, 6) "nDCG@10", round(n100, 6) "nDCG@100"
    from values_ v join v_queries q on q.qid = v.qid""",
    ctes=RANKED,
)
def evaluate_by_query(spark: SparkSession, d: str) -> DataFrame:
    result = m.evaluate_by_query(*judged(spark, d), tables.queries(spark, d))
    return rounded(result, *result.columns[2:])


def set_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    run, qrels = judged(spark, d)
    return qrels, run


@check(
    """select s.qid, round(coalesce(max(h.found), 0) / cast(12 as double), 6) as value
    from set_values s left join set_hits h on h.qid = s.qid and h.rank <= 12 group by s.qid""",
    ctes=SETS,
)
def set_precision_at_12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.set_precision_at(*set_inputs(spark, d), k=12))


@check(
    """select s.qid, case when h.hit then 1.0::double when not h.hit then 0.0::double end as value
    from set_values s left join set_hits h on h.qid = s.qid and h.rank = 1""",
    ctes=SETS,
)
def rel_at_1(spark: SparkSession, d: str) -> DataFrame:
    return m.rel_at(*set_inputs(spark, d), k=1)


SET_AP = """coalesce(sum(case when h.hit then h.found / cast(h.rank as double) else 0 end), 0)"""


@check(
    f"""select s.qid, round({SET_AP} / least(12, s.relevant), 6) as value
    from set_values s left join set_hits h on h.qid = s.qid and h.rank <= 12 group by s.qid, s.relevant""",
    ctes=SETS,
)
def set_ap_at_12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.set_ap_at(*set_inputs(spark, d), k=12))


@check(
    f"""select round(avg(value), 6) as mean from (
      select s.qid, {SET_AP} / least(10, s.relevant) as value
      from set_values s left join set_hits h on h.qid = s.qid and h.rank <= 10 group by s.qid, s.relevant)""",
    ctes=SETS,
)
def set_map_at_10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.set_map_at(*set_inputs(spark, d), k=10), "mean")


TIED = """
tied as (
  select qid, 10 + score gain, prediction, avg(10 + score) over (partition by qid, prediction) mean_gain,
    row_number() over (partition by qid order by prediction desc) rnk,
    row_number() over (partition by qid order by score desc) best from v_fair),
tied_values as (
  select qid, sum(mean_gain / log2(rnk + 1)) filter (rnk <= 10) / sum(gain / log2(best + 1)) filter (best <= 10) as value
  from tied group by qid)
"""


@check("select qid, round(value, 6) as value from tied_values", ctes=TIED)
def ndcg_tied(spark: SparkSession, d: str) -> DataFrame:
    fair = tables.fair(spark, d).withColumn("gain", 10 + F.col("score"))
    return rounded(m.ndcg_tied(fair, "gain", "prediction"))


@check("select round(coalesce(avg(value), 0), 6) as mean from tied_values", ctes=TIED)
def mean_metric(spark: SparkSession, d: str) -> DataFrame:
    fair = tables.fair(spark, d).withColumn("gain", 10 + F.col("score"))
    return rounded(m.mean_metric(m.ndcg_tied(fair, "gain", "prediction")), "mean")


@check(
    """select qid, round(coalesce(sum(t * t_upto / n_upto) / nullif(sum(t), 0), 0), 6) as value from (
      select *, sum(t) over (partition by qid order by score desc) t_upto,
        sum(n) over (partition by qid order by score desc) n_upto from (
        select qid, score, sum(relevance) t, count(*) n from v_fair group by qid, score))
    group by qid"""
)
def ap_from_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(m.ap_from_scores(tables.fair(spark, d), "relevance", "score"))


@check(
    """select count(*) filter (relevance = 0 and prediction = 0) tn, count(*) filter (relevance = 0 and prediction = 1) fp,
      count(*) filter (relevance = 1 and prediction = 0) fn, count(*) filter (relevance = 1 and prediction = 1) tp
    from v_fair"""
)
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return cl.confusion(tables.fair(spark, d), "relevance")


@check(
    """select round((tn + tp) / n, 6) accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) "precision",
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1
    from (select count(*) n, count(*) filter (relevance = 0 and prediction = 0) tn,
      count(*) filter (relevance = 0 and prediction = 1) fp, count(*) filter (relevance = 1 and prediction = 0) fn,
      count(*) filter (relevance = 1 and prediction = 1) tp from v_fair)"""
)
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cl.class_metrics(tables.fair(spark, d), "relevance"), "accuracy", "precision", "recall", "f1")


LOSSES = """
losses as (
  select l.qid, l.docid, logit0, logit1, case when j.qid is null then 0 else 1 end label,
    greatest(logit0, logit1) + ln(exp(logit0 - greatest(logit0, logit1)) + exp(logit1 - greatest(logit0, logit1)))
      - case when j.qid is null then logit0 else logit1 end loss
  from v_logits l left join v_qrels j on j.qid = l.qid and j.docid = l.docid)
"""


def labelled_logits(spark: SparkSession, d: str) -> DataFrame:
    scored = join_qrels(tables.logits(spark, d), tables.qrels(spark, d))
    return scored.withColumn("label", (F.col("label") > 0).cast("int"))


@check("select round(avg(loss), 6) as loss from losses", ctes=LOSSES)
def cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cl.cross_entropy(labelled_logits(spark, d)), "loss")


@check(
    f"""select round(avg(loss), 6) as loss, round(cast(sum(correct) as double) / sum(n), 6) as accuracy from (
      select batch, avg(loss) loss, count(*) n,
        count(*) filter (case when logit1 > logit0 then 1 else 0 end = label) correct from (
        select *, (row_number() over (order by {hashed('qid', 'docid')}) - 1) // 32 batch from losses)
      group by batch)""",
    ctes=LOSSES,
)
def batched_loss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cl.batched_loss(labelled_logits(spark, d), ["qid", "docid"]), "loss", "accuracy")


def mix_sql(by: str, source: str = "v_fair") -> str:
    keys = f"{by}, " if by else ""
    return f"""select {keys}prediction, annotation, total, round(rows / cast(total as double), 6) fraction from (
      select {keys}prediction, annotation, count(*) rows,
        cast(sum(count(*)) over (partition by {keys}prediction) as bigint) total
      from {source} where annotation is not null group by {keys}prediction, annotation)"""


def long_form(df: DataFrame, keys: list[str]) -> DataFrame:
    """The two maps of a fairness table as rows."""
    parts = []
    for prediction, total, fractions in (
        (1, "total_rel_annotation_count", "relevant_frac_annotation"),
        (0, "total_non_annotation_count", "non_relevant_frac_annotation"),
    ):
        rows = df.select(*keys, F.col(total).alias("total"), F.explode(fractions).alias("annotation", "fraction"))
        parts.append(rows.withColumn("prediction", F.lit(prediction)))
    return rounded(parts[0].unionByName(parts[1]), "fraction")


@check(f"select annotation, total, fraction from ({mix_sql('')}) where prediction = 1")
def annotation_mix(spark: SparkSession, d: str) -> DataFrame:
    mix = fa.annotation_mix(tables.fair(spark, d), "relevant")
    return rounded(mix.select("total", F.explode("fractions").alias("annotation", "fraction")), "fraction")


@check(mix_sql(""))
def fairness_report(spark: SparkSession, d: str) -> DataFrame:
    return long_form(fa.fairness_report(tables.fair(spark, d)), [])


@check(mix_sql("qid, query"))
def fairness_by_query(spark: SparkSession, d: str) -> DataFrame:
    return long_form(fa.fairness_by_query(tables.fair(spark, d)), ["qid", "query"])


@check(mix_sql("qid"))
def mix_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = fa.mix_rows(tables.fair(spark, d), ["qid", "prediction"])
    return rounded(rows.select("qid", "prediction", "annotation", "total", "fraction"), "fraction")


@check(
    mix_sql("qid, query", "top"),
    ctes="""top as (select * from (
      select *, row_number() over (partition by qid order by score desc, docid) rank from v_fair) where rank <= 10)""",
)
def fairness_at_10(spark: SparkSession, d: str) -> DataFrame:
    return long_form(fa.fairness_at_k(rerank(tables.fair(spark, d)), 10), ["qid", "query"])
