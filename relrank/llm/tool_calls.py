"""Tool calls of chats: linked to their results, put in order, checked against schemas, written as canonical JSON.

DataFrame operations only; everything is joined on identifiers, and nothing gathers a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.llm.common import stored

# JSON's kinds by the type names of variants.
KINDS = {
    "STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number", "FLOAT": "number", "DECIMAL": "number",
    "ARRAY": "array", "OBJECT": "object",
}


def _kind(variant: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return names[F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)]


def json_string(text: Column) -> Column:
    """A text as a JSON string, quoted and escaped; null for null."""
    whole = F.to_json(F.struct(text.alias("v")))  # {"v":"..."}
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.char_length(whole) - 6))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): a call without a parent among ``calls`` has level 0, any other one more than its
    parent; null on a cycle and below one. ``calls``: conv_id, call_id, parent_id, one row per identifier.

    Every round doubles the way that a call has gone up, so rounds grow with the logarithm of the longest chain; a way
    longer than the longest conversation has calls runs in a circle.
    """
    own = calls.select("conv_id", "call_id", "parent_id")
    known = own.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p"))
    here = (F.col("conv_id") == F.col("c")) & (F.col("parent_id") == F.col("p"))
    state = stored(own.join(known, here, "left").select("conv_id", "call_id", F.col("p").alias("up"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("level")))
    longest = state.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    gone = 1
    while gone <= longest and not state.where("up is not null").isEmpty():
        above = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("up").alias("next"), F.col("level").alias("more"))
        there = (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("i"))
        way = F.col("level") + F.coalesce("more", F.lit(0))
        state = stored(state.join(above, there, "left").select("conv_id", "call_id", F.col("next").alias("up"), way.alias("level")))
        gone *= 2
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def _first_of(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each (conv_id, call_id)."""
    return rows.groupBy("conv_id", "call_id").agg(F.min(F.struct(*order)).alias("row")).select("conv_id", "call_id", "row.*")


def _problems(arguments: Column, fields: Column) -> Column:
    """What is wrong with a map of arguments, sorted; ``fields`` is the tool's list of (field, kind, required)."""
    missing = F.filter(fields, lambda f: f["required"] & ~F.map_contains_key(arguments, f["field"]))
    given = F.filter(fields, lambda f: F.map_contains_key(arguments, f["field"]))
    fits = lambda f, kind: (kind == f["kind"]) | ((f["kind"] == "number") & (kind == "integer"))
    wrong = F.filter(given, lambda f: ~F.coalesce(fits(f, _kind(F.element_at(arguments, f["field"]))), F.lit(False)))
    extra = F.filter(F.map_keys(arguments), lambda k: ~F.exists(fields, lambda f: f["field"] == k))
    texts = F.concat(
        F.transform(missing, lambda f: F.concat(F.lit("missing "), f["field"])),
        F.transform(wrong, lambda f: F.concat(F.lit("wrong "), f["field"])),
        F.transform(extra, lambda k: F.concat(F.lit("unknown "), k)),
    )
    return (
        F.when(fields.isNull(), F.array(F.lit("no schema")))
        .when(arguments.isNull(), F.array(F.lit("no object")))
        .otherwise(F.array_sort(texts))
    )


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every call with its result, its place in order, what is wrong with it, and as canonical JSON.

    ``calls``: conv_id, call_id, parent_id (the call whose result it uses, or null), seq, name, arguments (JSON text).
    ``results``: conv_id, call_id, seq, content. ``schemas``: name, field, kind (of KINDS), required; a field with null
    name is none. Of rows that repeat an identifier the first by seq counts, then by their other columns. Rows whose
    conv_id or call_id is null have no identifier and are left as they are: calls without result, results without call.

    Returns conv_id, call_id, level, seq, name, problems (joined by "; "), status and json. Sorted by (conv_id, level,
    seq) no call comes before its parent; level is null on a cycle. Status: ``cycle``, ``invalid`` (it has problems),
    ``no result``, ``linked``, or ``no call`` for a result that no call asks for (level, name and problems are null).
    JSON has sorted keys, no blanks, and the arguments as they parse, or as a string where they are no JSON.
    Empty tables give an empty result.
    """
    asked = calls.select("conv_id", "call_id", "parent_id", F.col("seq").cast("long").alias("seq"), "name", "arguments")
    came = results.select("conv_id", "call_id", F.col("seq").cast("long").alias("seq"), "content")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = stored(_first_of(asked.where(named), ["seq", "name", "arguments", "parent_id"]).withColumn("asked", F.lit(True)))
    reply = _first_of(came.where(named), ["seq", "content"])
    reply = reply.select("conv_id", "call_id", F.col("seq").alias("reply_seq"), "content", F.lit(True).alias("replied"))
    # Hash joins: identifiers are single on both sides, so tables of a partition are as even as the rows.
    ordered = one.join(levels(one).hint("shuffle_hash"), ["conv_id", "call_id"])
    linked = ordered.join(reply.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    nameless = asked.where(~named).select("*", F.lit(0).cast("long").alias("level"))
    stray = came.where(~named).select("conv_id", "call_id", F.col("seq").alias("reply_seq"), "content", F.lit(True).alias("replied"))
    linked = linked.unionByName(nameless.withColumn("asked", F.lit(True)), True).unionByName(stray, True)
    linked = linked.withColumn("asked", F.coalesce("asked", F.lit(False)))
    # A tool's fields are one row; their number is that of the schema.
    fields = F.array_sort(F.collect_list(F.struct("field", "kind", F.coalesce("required", F.lit(False)).alias("required"))))
    tools = schemas.where("name is not null and field is not null").groupBy("name").agg(fields.alias("fields"))
    checked = linked.join(tools, "name", "left")

    parsed = F.try_parse_json("arguments")
    map_of = F.try_variant_get(parsed, "$", "map<string,variant>")
    checked = checked.withColumn("problems", F.when(F.col("asked"), _problems(map_of, F.col("fields"))))
    status = (
        F.when(~F.col("asked"), "no call")
        .when(F.col("level").isNull(), "cycle")
        .when(F.size("problems") > 0, "invalid")
        .when(F.col("replied").isNull(), "no result")
        .otherwise("linked")
    )
    quoted = lambda c: F.coalesce(json_string(F.col(c).cast("string")), F.lit("null"))
    members = [
        ("arguments", F.coalesce(F.to_json(parsed), quoted("arguments"))), ("content", quoted("content")), ("conversation", quoted("conv_id")), ("id", quoted("call_id")),
        ("level", F.coalesce(F.col("level").cast("string"), F.lit("null"))), ("name", quoted("name")), ("parent", quoted("parent_id")),
    ]
    parts = [F.concat(F.lit(f'{"," if i else ""}"{key}":'), value) for i, (key, value) in enumerate(members)]
    return checked.select(
        "conv_id", "call_id", "level", F.coalesce("seq", "reply_seq").alias("seq"), "name",
        F.array_join("problems", "; ").alias("problems"), status.alias("status"), F.concat(F.lit("{"), *parts, F.lit("}")).alias("json"),
    )
