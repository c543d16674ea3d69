"""Hash-ordered sampling: pairs, prompts, splits, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relrank.checks.registry import DOC_TEXT, check, clean, hash_number, hashed, stored_run
from relrank.operators import sampling as s
from relrank.operators.candidates import to_qrels
from relrank.plans.flows import training_prompts
from relrank.sources import tables

PAIRS = f"""
judged as (select distinct qid, docid from v_qrels where label = 1),
drawn as (
  select qid, arg_min(docid, {hashed('qid', 'docid')}) docid from judged
  where qid in (select qid from v_run) and qid in (select qid from v_queries) group by qid),
chosen as (select * from drawn where docid in (select docid from v_docs)),
top as (
  select qid, docid from v_run where rank <= 5 and qid in (select qid from chosen)
    and docid in (select docid from v_docs)),
negative as (
  select qid, arg_min(docid, {hashed('qid', 'docid')}) docid from (
    select * from top except select * from chosen) group by qid),
negative_of_judged as (
  select qid, arg_min(docid, {hashed('qid', 'docid')}) docid from (
    select * from top except select * from judged) group by qid)
"""

TRIPLES = f"""
triple_judged as (select distinct qid, docid from v_qrels where label = 1),
triple_drawn as (select qid, arg_min(docid, {hashed('qid', 'docid')}) docid from triple_judged group by qid),
triple_rows as (
  select r.qid, r.docid n_docid, p.docid p_docid,
    case when r.rank <> 1 + {hash_number('r.qid')} % 100 then 'skipped'
      when q.qid is null or p.docid is null or d.docid is null then 'missing_data'
      when j.qid is not null then 'docid_collision' else 'kept' end status
  from v_run r left join v_queries q on q.qid = r.qid left join triple_drawn p on p.qid = r.qid
  left join v_docs d on d.docid = r.docid left join triple_judged j on j.qid = r.qid and j.docid = r.docid),
triples as (
  select t.qid, q.query, p.docid p_docid, p.url p_url, p.title p_title, p.body p_body,
    n.docid n_docid, n.url n_url, n.title n_title, n.body n_body
  from (select * from triple_rows where status = 'kept') t
  join v_queries q on q.qid = t.qid join v_docs p on p.docid = t.p_docid join v_docs n on n.docid = t.n_docid)
"""

QRELS_PAIRS = f"""
fair_qrels as (select distinct qid, docid from v_fair where relevance = 1),
by_hash as (select qid, row_number() over (order by {hashed('qid')}) n from (select distinct qid from fair_qrels)),
topics as (select (count(distinct qid) + 1) // 2 half, count(*) pairs from fair_qrels),
ring as (select docid, row_number() over (order by {hashed('docid')}) - 1 place from v_docs),
size as (select count(*) n from v_docs),
filled as (select docid, {clean('body')} doc from v_docs)
"""


def inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return stored_run(spark, d), tables.queries(spark, d), tables.qrels(spark, d), tables.docs(spark, d)


def with_text(ids: str) -> str:
    return f"""select p.qid, p.docid, {clean('q.query')} query, {clean(DOC_TEXT)} doc
    from {ids} p join v_queries q on q.qid = p.qid join v_docs d on d.docid = p.docid"""


@check(with_text("chosen"), ctes=PAIRS)
def sample_positive(spark: SparkSession, d: str) -> DataFrame:
    return s.sample_positive(*inputs(spark, d))


@check(with_text("negative"), ctes=PAIRS)
def sample_negative(spark: SparkSession, d: str) -> DataFrame:
    return s.sample_negative(*inputs(spark, d))


@check(with_text("negative_of_judged"), ctes=PAIRS)
def sample_negative_of_judged(spark: SparkSession, d: str) -> DataFrame:
    return s.sample_negative(*inputs(spark, d), exclude="judged")


@check(
    """select status, count(*) queries from (
      select case when d.qid is null then 'missing_data' when n.qid is null then 'missing_docs' else 'kept' end status
      from (select distinct qid from v_run) r left join drawn d on d.qid = r.qid left join negative n on n.qid = r.qid)
    group by status""",
    ctes=PAIRS,
)
def pair_stats(spark: SparkSession, d: str) -> DataFrame:
    return s.pair_stats(*inputs(spark, d))


@check(f"select qid, docid, rank from v_run order by {hashed('qid', 'docid')} limit 1000")
def sample_n(spark: SparkSession, d: str) -> DataFrame:
    return s.sample_n(tables.run(spark, d), 1000, ["qid", "docid"]).select("qid", "docid", "rank")


@check(
    f"""select concat('Query:', query, chr(10), 'Document:', doc) as text, label from (
      select query, doc, relevance as label,
        row_number() over (partition by relevance order by {hashed('qid', 'docid')}) n from v_fair)
    where n <= (select least(count(*) filter (relevance = 1), count(*) filter (relevance = 0)) from v_fair)"""
)
def balanced_prompts(spark: SparkSession, d: str) -> DataFrame:
    """All prompts of the scarcer class, and as many of the other."""
    fair = tables.fair(spark, d)
    return s.balanced_prompts(fair.where("relevance = 1"), fair.where("relevance = 0")).select("text", "label")


@check(
    f"""select concat('Query:', query, chr(10), 'Document:', doc) as text, label from (
      select query, doc, 1 as label from (select *, row_number() over (order by {hashed('qid', 'docid')}) n from positive_text)
      where n <= (select count(*) from negative) union all select query, doc, 0 from negative_text)""",
    ctes=PAIRS + f", positive_text as ({with_text('chosen')}), negative_text as ({with_text('negative')})",
    name="training_prompts",
)
def all_training_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A prompt for every pair: as many of each class as the scarcer one has."""
    return training_prompts(*inputs(spark, d)).select("text", "label")


@check(f"select qid, query, doc, {hashed('qid')} as place from v_turns")
def shuffle(spark: SparkSession, d: str) -> DataFrame:
    shuffled = s.shuffle(tables.turns(spark, d), ["qid"])
    return shuffled.withColumn("place", s.hash_key(0, "qid"))


@check("select label, count(*) as rows from v_qrels group by label")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return s.label_counts(tables.qrels(spark, d))


@check(
    f"""select qid, case when row_number() over (order by {hashed('qid')})
      <= ceil(cast(0.2 as double) * count(*) over ()) then 'test' else 'train' end part from v_turns"""
)
def split_train_test(spark: SparkSession, d: str) -> DataFrame:
    return s.split_train_test(tables.turns(spark, d), ["qid"]).select("qid", "part")


@check(f"select qid, case when {hash_number('qid')} < 858993459 then 'test' else 'train' end part from v_turns")
def split_train_test_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return s.split_train_test(tables.turns(spark, d), ["qid"], exact=False).select("qid", "part")


@check("select * from triples", ctes=TRIPLES)
def make_triples(spark: SparkSession, d: str) -> DataFrame:
    return s.flatten_triples(s.make_triples(*inputs(spark, d)))


@check("select status, count(*) as rows from triple_rows group by status", ctes=TRIPLES)
def triple_stats(spark: SparkSession, d: str) -> DataFrame:
    return s.triple_stats(*inputs(spark, d))


def fair_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    fair = tables.fair(spark, d)
    topics = fair.select("qid", "query").distinct()
    return to_qrels(fair), topics, tables.docs(spark, d)


POSITIVES = f"""select r.qid, r.docid, concat('topic ', r.qid) query, f.doc, 1 relevance
    from fair_qrels r join by_hash b on b.qid = r.qid join filled f on f.docid = r.docid
    where b.n <= (select half from topics) and f.doc <> ''
    qualify row_number() over (order by {hashed('r.qid', 'r.docid')}) <= (select pairs from topics)"""

NEGATIVES = f"""select a.qid, a.docid, concat('topic ', a.qid) query, f.doc, 0 relevance from (
      select b.qid, arg_min(r.docid, (r.place - {hash_number('b.qid')} % s.n + s.n) % s.n) docid
      from (select qid from by_hash where n > (select half from topics)) b, ring r, size s
      where not exists (select 1 from fair_qrels q where q.qid = b.qid and q.docid = r.docid)
      group by b.qid) a
    join filled f on f.docid = a.docid where f.doc <> ''"""


def every_topic(spark: SparkSession, d: str) -> dict:
    """Half of the topics give all their positives, all others a negative each."""
    topics, pairs = tables.fair(spark, d).where("relevance = 1").selectExpr("count(distinct qid)", "count(*)").first()
    return {"top_k": (topics + 1) // 2, "max_pos": pairs}


@check(POSITIVES, ctes=QRELS_PAIRS)
def qrels_positives(spark: SparkSession, d: str) -> DataFrame:
    return s.qrels_positives(*fair_inputs(spark, d), **every_topic(spark, d))


@check(NEGATIVES, ctes=QRELS_PAIRS)
def qrels_negatives(spark: SparkSession, d: str) -> DataFrame:
    return s.qrels_negatives(*fair_inputs(spark, d), **every_topic(spark, d))


@check(f"select * from ({POSITIVES}) union all select * from ({NEGATIVES})", ctes=QRELS_PAIRS)
def qrels_pairs(spark: SparkSession, d: str) -> DataFrame:
    return s.qrels_pairs(*fair_inputs(spark, d), **every_topic(spark, d))
