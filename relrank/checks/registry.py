"""The registry, and the SQL of the views in ``relrank.sources.tables``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relrank.functions.text import STRIPPED
from relrank.session import checkpoint, stage_folder
from relrank.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VIEWS = r"""
v_docs as (
  select concat('D', cast(doc_id as varchar)) docid, source url, split_part(text, chr(10), 1) title, text body
  from documents),
v_queries as (select cast(item_id as varchar) qid, text query from benchmark),
v_qrels as (
  select distinct cast(b.item_id as varchar) qid, 'Q0' iter, concat('D', cast(d.doc_id as varchar)) docid,
    cast(1 + coalesce(l.quality, 0) as int) label
  from benchmark b join documents d on contains(d.text, b.text) left join labels l on l.doc_id = d.doc_id),
v_qtok as (select distinct qid, unnest(regexp_extract_all(lower(query), '[a-z]{4,}', 0)) w from v_queries),
v_dtok as (select distinct docid, unnest(regexp_extract_all(lower(body), '[a-z]{4,}', 0)) w from v_docs),
v_run as (
  select qid, 'Q0' iter, docid, cast(rnk as int) rank, score, 'lex' tag from (
    select qid, docid, score, row_number() over (partition by qid order by score desc, docid desc) rnk from (
      select q.qid, d.docid, cast(count(*) as double) score
      from v_qtok q join v_dtok d on q.w = d.w group by q.qid, d.docid))
  where rnk <= 100),
v_logits as (
  select r.qid, r.docid, r.rank, n.n - r.score logit0, r.score logit1
  from v_run r join (select qid, cast(count(*) as double) n from v_qtok group by qid) n on r.qid = n.qid),
v_fair as (
  select d.source qid, concat('D', cast(d.doc_id as varchar)) docid, concat('topic ', d.source) query, d.text doc,
    l.quality relevance, l.toxic annotation, case when d.n_chars > 1500 then 1 else 0 end prediction,
    cast(d.n_chars as double) score
  from documents d join labels l on l.doc_id = d.doc_id),
v_turns as (
  select concat(cast(u.conv_id as varchar), '-', cast(u.turn as varchar)) qid, u.text query, a.text doc
  from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant')
"""

# Every character the clean function strips, as a SQL expression.
BLANKS = "concat(" + ", ".join(f"chr({ord(c)})" for c in STRIPPED) + ")"


def clean(expression: str) -> str:
    return f"trim(coalesce({expression}, ''), {BLANKS})"


DOC_TEXT = "concat('Title: ', coalesce(title, ''), ', Context: ', coalesce(body, ''))"


def words(expression: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({expression}), '[a-z]{{4,}}', 0))"


def hashed(*columns: str, seed: int = 0) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(columns)}))"


def hash_number(*columns: str, seed: int = 0) -> str:
    return f"cast(concat('0x', substr({hashed(*columns, seed=seed)}, 1, 8)) as bigint)"


def stored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run as a stored table, for operators that read it more than once."""
    return checkpoint(tables.run(spark, sf_dir))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def check(sql: str | None = None, ctes: str = "", name: str | None = None):
    """Register a query under its function's name; ``ctes`` extend the views its SQL can use."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = f"with {VIEWS}{',' + ctes if ctes else ''} {sql}"
        return function

    return register
