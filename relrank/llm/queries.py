"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relrank.llm import byte_bpe, decontamination, language_id, licenses, warc
from relrank.llm.common import stored_by_small_batches, table
from relrank.llm.exact_dedup import exact_dedup
from relrank.llm.html_text import extract_text
from relrank.llm.near_dedup import near_duplicates
from relrank.llm.spelling import spelling_variants
from relrank.llm.suffix_dedup import suffix_dedup
from relrank.llm.tool_calls import json_string, link_tool_calls
from relrank.llm.token_counts import Unigram, count_tokens
from relrank.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op3_exact_dedup"] = r"""
with plain as (
  select doc_id, length(coalesce(text, '')) n_chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256
  from documents),
ranked as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n_chars desc, doc_id) keep_id,
    count(*) over (partition by text_sha256) group_size
  from plain)
select doc_id, keep_id, group_size, doc_id = keep_id kept, text_sha256 from ranked
"""


def byte_vocabulary(spark: SparkSession) -> byte_bpe.Vocabulary:
    return byte_bpe.Vocabulary.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_by_small_batches(byte_bpe.round_trip(table(spark, sf_dir, "documents"), byte_vocabulary(spark)))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs)
    known = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.predict(known, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan_licenses(table(spark, sf_dir, "documents")))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(table(spark, sf_dir, "documents"), model)


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLE["op12_warc"] = """
with payloads as (
  select page_id, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
firsts as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end keeper from payloads)
select page_id, cast(payload_bytes as bigint) payload_bytes, payload_digest,
  case when keeper is null or keeper = page_id then 'response' else 'revisit' end record_type,
  case when keeper <> page_id then keeper end refers_to
from firsts
"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


# Tool calls that Spark derives from the conversations: each assistant turn calls a tool, the next turn is its result.
TOOL_SCHEMAS = """
select * from values
  ('lookup', 'exact', 'boolean', false), ('lookup', 'limit', 'integer', true), ('lookup', 'query', 'string', true),
  ('search', 'limit', 'number', true), ('search', 'query', 'string', true), ('summarise', 'query', 'string', true),
  ('summarise', 'limit', 'integer', false), ('summarise', 'exact', 'boolean', false)
  as tools(name, field, kind, required)
"""


@query
def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    key = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    quoted = json_string(F.col("text"))
    kind = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(10))
    arguments = (
        F.when(kind == 0, F.concat(F.lit('{"query": '), quoted))
        .when(kind == 1, F.concat(F.lit('{"query": '), quoted, F.lit(', "limit": "ten"}')))
        .when(kind == 2, F.lit('{"limit": 5}'))
        .when(kind == 3, F.concat(F.lit('{"query": '), quoted, F.lit(', "extra": [1, 2], "limit": 3}')))
        .when(kind == 4, F.lit("[1, 2]"))
        .otherwise(F.concat(F.lit('{ "query" : '), quoted, F.lit(', "limit": '), F.char_length("text").cast("string"), F.lit(', "exact": true }')))
    )
    own = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    calls = turns.where("role = 'assistant' and text is not null").select(
        "conv_id",
        key(F.col("turn")).alias("call_id"),
        F.when(own != 3, key(F.col("turn") - 2)).alias("parent_id"),
        F.col("turn").alias("seq"),
        F.element_at(F.array(*map(F.lit, ("search", "lookup", "summarise", "paint"))), own.cast("int") + 1).alias("name"),
        arguments.alias("arguments"),
    )
    results = turns.where("turn > 0 and not role <=> 'assistant'").select(
        "conv_id", key(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content")
    )
    return link_tool_calls(calls, results, spark.sql(TOOL_SCHEMAS))


ORACLE["op5_tool_calls"] = """
with recursive calls as (
  select conv_id, turn, concat(conv_id, '-', turn) call_id, cast(to_json(text) as varchar) q, length(text) n,
    (conv_id * 7 + turn) % 10 kind, ['search', 'lookup', 'summarise', 'paint'][(conv_id + turn) % 4 + 1] name,
    case when (conv_id + turn) % 4 <> 3 then concat(conv_id, '-', turn - 2) end parent_id
  from conversations where role = 'assistant' and text is not null),
ordered as (
  select conv_id, call_id, 0 as level from calls c
  where parent_id is null or not exists (from calls p where p.conv_id = c.conv_id and p.call_id = c.parent_id)
  union all
  select c.conv_id, c.call_id, o.level + 1 from calls c join ordered o on c.conv_id = o.conv_id and c.parent_id = o.call_id),
results as (
  select conv_id, concat(conv_id, '-', turn - 1) call_id, turn, text from conversations where turn > 0 and role is distinct from 'assistant'),
linked as (
  select coalesce(c.conv_id, r.conv_id) conv_id, coalesce(c.call_id, r.call_id) call_id, o.level, coalesce(c.turn, r.turn) seq, c.name,
    case when c.call_id is null then null when name = 'paint' then 'no schema' when kind in (0, 4) then 'no object' when kind = 1 then 'wrong limit'
      when kind = 2 then 'missing query' when kind = 3 then 'unknown extra' when name = 'search' then 'unknown exact' else '' end problems,
    case kind when 0 then cast(to_json(concat('{"query": ', q)) as varchar) when 1 then concat('{"limit":"ten","query":', q, '}') when 2 then '{"limit":5}'
      when 3 then concat('{"extra":[1,2],"limit":3,"query":', q, '}') when 4 then '[1,2]'
      else concat('{"exact":true,"limit":', n, ',"query":', q, '}') end arguments,
    c.call_id is not null asked, r.call_id is not null replied, r.text content, parent_id
  from calls c left join ordered o on o.conv_id = c.conv_id and o.call_id = c.call_id
    full join results r on r.conv_id = c.conv_id and r.call_id = c.call_id)
select conv_id, call_id, cast(level as bigint) as level, seq, name, problems,
  case when not asked then 'no call' when problems <> '' then 'invalid' when not replied then 'no result' else 'linked' end status,
  concat('{"arguments":', case when asked then arguments else 'null' end, ',"content":', coalesce(cast(to_json(content) as varchar), 'null'),
    ',"conversation":"', conv_id, '","id":"', call_id, '","level":', coalesce(cast(level as varchar), 'null'),
    ',"name":', coalesce(cast(to_json(name) as varchar), 'null'), ',"parent":', coalesce(cast(to_json(parent_id) as varchar), 'null'), '}') json
from linked
"""
