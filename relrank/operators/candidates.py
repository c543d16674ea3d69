"""Filters and caps on runs and judgments, and their joins to text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.functions.text import clean, doc_text, parse_annotation
from relrank.operators.ordering import head_of_group, run_order, running_totals
from relrank.schemas import require_columns
from relrank.session import checkpoint


def positives(qrels: DataFrame, label: int = 1) -> DataFrame:
    """Judgments of exactly ``label``: higher grades do not count as positive for training."""
    return qrels.where(F.col("label") == label)


def head_per_query(run: DataFrame, k: int, mode: str = "rank", line: str = "line") -> DataFrame:
    """The first k candidates of each query.

    ``mode='rank'`` orders by rank. ``mode='runs'`` follows the file instead, in the order of the column
    ``line``: the count starts again whenever the query id changes, so a query whose lines come in two
    blocks keeps k of each.
    """
    if mode == "rank":
        return head_of_group(run, ["qid"], run_order(), k).drop("_at")
    if mode != "runs":
        raise ValueError(f"mode must be 'rank' or 'runs', not {mode!r}")
    require_columns(run, line)
    # Lines of one block share (line number in the file) - (line number within the query).
    numbered = running_totals(run, [], [line], {"_in_file": F.lit(1)})
    numbered = running_totals(numbered, ["qid"], [line], {"_in_query": F.lit(1)})
    blocks = numbered.withColumn("_block", F.col("_in_file") - F.col("_in_query"))
    return head_of_group(blocks, ["qid", "_block"], [line], k).select(*run.columns)


def union_ids(a: DataFrame, b: DataFrame, key: str = "docid") -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def common_ids(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("qid", "docid")) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def minus(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``a`` whose keys do not occur in ``b``."""
    return a.join(b.select(*keys), list(keys), "left_anti")


def union_aligned(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def required_docs(run: DataFrame, k: int, judged: DataFrame | None = None) -> DataFrame:
    """Ids of the documents among the first k of any query, and of the judged ones if given."""
    ids = head_per_query(run, k).select("docid").distinct()
    return ids if judged is None else union_ids(ids, judged)


def judged_queries(qrels: DataFrame) -> DataFrame:
    return qrels.select("qid").distinct()


def to_qrels(fair: DataFrame) -> DataFrame:
    return fair.select("qid", F.lit("Q0").alias("run"), "docid", F.col("relevance").cast("int").alias("label"))


def with_docno(df: DataFrame) -> DataFrame:
    return df if "docno" in df.columns else df.withColumn("docno", F.col("docid"))


def project_run(df: DataFrame, fair: bool = False) -> DataFrame:
    columns = ["qid", "docid", "rank", "score", "prediction"]
    if fair:
        columns = ["qid", "query", "docid", "rank", "score", "prediction", "annotation"]
    return require_columns(df, *columns).select(*columns)


def skip_queries(run: DataFrame, n: int) -> DataFrame:
    """Everything but the first n queries in qid order: where an interrupted job goes on."""
    if n <= 0:
        return run
    numbered = running_totals(run.select("qid").distinct(), [], ["qid"], {"_at": F.lit(1)})
    last_done = numbered.where(F.col("_at") == n).select("qid").scalar()  # null, and nothing left, if there are fewer
    return run.where(F.col("qid") > last_done)


def prune_docs(docs: DataFrame, required: DataFrame) -> DataFrame:
    return docs.join(required.select("docid"), "docid", "left_semi")


def fetch_docs(ids: DataFrame, docs: DataFrame, strict: bool = False) -> DataFrame:
    """The body of each wanted document. Ids without a document are dropped, or fail when ``strict``."""
    text = docs.select("docid", clean("body").alias("doc"))
    if not strict:
        return ids.join(text, "docid")
    message = F.concat(F.lit("no document "), F.col("docid"))
    found = ids.join(text, "docid", "left")
    return found.withColumn("doc", F.coalesce("doc", F.raise_error(message).cast("string")))


def doc_contents(docs: DataFrame) -> DataFrame:
    """docid and the text shown to a model: title and body in one string."""
    return docs.select("docid", clean(doc_text("title", "body")).alias("doc"))


def map_run(
    run: DataFrame,
    queries: DataFrame,
    docs: DataFrame,
    k: int | None = None,
    only: DataFrame | None = None,
    prepare: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """Each run row with its query and document text, where both exist.

    ``prepare`` is applied to every text once, before the join repeats it. ``k`` limits the documents to those among the
    first k of some query; a row further down stays if another query needs its document. ``only`` restricts the run to
    some queries.
    """
    if only is not None:
        run = run.join(only.select("qid"), "qid", "left_semi")
    run = checkpoint(run.select("qid", "docid", "rank", "score"))  # read twice: for the documents, and for the rows
    # Only documents of the run are cleaned and prepared.
    docs = prune_docs(docs, run.select("docid").distinct() if k is None else required_docs(run, k))
    return (
        run.join(queries.select("qid", prepare(clean("query")).alias("query")), "qid")
        .join(doc_contents(docs).withColumn("doc", prepare(F.col("doc"))), "docid")
        .select("qid", "docid", "query", "doc", "rank", F.col("score").alias("run_score"))
    )


def mapped_run_file(mapped: DataFrame) -> DataFrame:
    """The columns under their file names; the retrieval score is called relevance there."""
    return mapped.withColumnRenamed("run_score", "relevance")


def map_stats(run: DataFrame, queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """How many run rows ``map_run`` keeps, and how many lack a query or a document."""
    if k is not None:
        docs = prune_docs(docs, required_docs(run, k))
    has_query = queries.select("qid", F.lit(True).alias("_query"))
    has_doc = docs.select("docid", F.lit(True).alias("_doc"))
    found = run.join(has_query, "qid", "left").join(has_doc, "docid", "left")
    both = F.col("_query").isNotNull() & F.col("_doc").isNotNull()
    return found.agg(F.count_if(both).alias("kept"), F.count_if(~both).alias("missing_data"))


def map_top_k(run: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """The first k candidates of each query with query text and document body."""
    top = head_per_query(run, k)
    return (
        top.join(queries.select("qid", clean("query").alias("query")), "qid")
        .join(docs.select("docid", clean("body").alias("doc_content")), "docid")
        .select("qid", "docid", "query", "doc_content", "rank", "score")
    )


def assign_qids(stems: DataFrame, name: str = "stem") -> DataFrame:
    """Number the distinct file stems 1, 2, … in name order."""
    distinct = stems.select(name).distinct()
    return running_totals(distinct, [], [name], {"qid": F.lit(1)}).withColumn(
        "qid", F.col("qid").cast("string")
    )


def first_annotation(annotations: DataFrame) -> DataFrame:
    """One annotation per (stem, docid): the first in the file."""
    return annotations.groupBy("stem", "docid").agg(F.min_by("mapped_annotation", "pos").alias("mapped_annotation"))


def build_fair(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Documents of the fairness files joined to their annotations.

    ``docs`` has stem, query, docid, title, body; ``annotations`` has stem, docid, mapped_annotation
    ('rel,senti') and pos, the place in the file.
    """
    relevance, annotation = parse_annotation("mapped_annotation")
    return (
        docs.join(first_annotation(annotations), ["stem", "docid"])
        .join(assign_qids(docs), "stem")
        .select(
            "qid", "docid", "query", doc_text("title", "body").alias("doc"),
            relevance.alias("relevance"), annotation.alias("annotation"),
        )
    )


def unannotated(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """How many documents of the fairness files have no annotation."""
    return minus(docs, annotations, ["stem", "docid"]).agg(F.count("*").alias("unannotated"))


def judgments(qrels: DataFrame) -> DataFrame:
    """qid, docid, label: one judgment per pair, the highest of repeated ones."""
    ids = [F.col("qid").cast("string").alias("qid"), F.col("docid").cast("string").alias("docid")]
    return qrels.groupBy(*ids).agg(F.max("label").alias("label"))


def join_qrels(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with its labels; an unjudged document has label 0, of repeated judgments the highest counts."""
    labels = judgments(qrels)
    return run.join(labels, ["qid", "docid"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def positions(run: DataFrame, k: int | None = None) -> DataFrame:
    """The candidates of each query, or the first k, with their position 0, 1, …"""
    if k is None:
        numbered = running_totals(run, ["qid"], run_order(), {"pos": F.lit(1)})
    else:
        numbered = head_of_group(run, ["qid"], run_order(), k, "pos")
    return numbered.withColumn("pos", (F.col("pos") - 1).cast("int"))


PAIR_BLOCK = 64  # candidates of a query that meet those of another block in one task


def pair_candidates(run: DataFrame, k: int | None = None, carry: Sequence[str] = (), block: int = PAIR_BLOCK) -> DataFrame:
    """Every pair (a before b) among the candidates of a query, or among its first k: n(n-1)/2 rows for n of them.

    Comparing all pairs is what the method asks for; cap the run first (``head_per_query``) where lists are long. The
    candidates of a query stand in blocks; each two blocks are a key of the join, so that a long list is dealt out over the
    tasks, and a document is sent once for each block instead of once for each pair.

    ``carry`` names document columns to bring along; they get the suffixes _a and _b.
    """
    columns = ["pos", "docid", *carry]
    top = checkpoint(positions(run, k).select("qid", *columns)).withColumn("_own", F.floor(F.col("pos") / block))
    last = top.groupBy("qid").agg(F.max("_own").alias("_last"))
    side = lambda name: [F.col(c).alias(f"{c}_{name}") for c in columns]
    a = top.join(last, "qid").select("qid", F.col("_own").alias("_one"), F.explode(F.sequence("_own", "_last")).alias("_two"), *side("a"))
    b = top.select("qid", F.explode(F.sequence(F.lit(0).cast("long"), "_own")).alias("_one"), F.col("_own").alias("_two"), *side("b"))
    return a.join(b, ["qid", "_one", "_two"]).where(F.col("pos_a") < F.col("pos_b")).drop("_one", "_two")
