"""Training data by hash-ordered sampling: pairs, prompts, splits, triples.

Every random draw is the smallest hash of (seed, ids), so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relrank.functions.hashing import first_by_hash, hash_key, hash_number, hash_position, mark_first
from relrank.functions.text import clean, first_chunk, pair_prompt, point_prompt
from relrank.operators.candidates import doc_contents, head_per_query, minus, positives, union_aligned
from relrank.schemas import require_columns
from relrank.session import checkpoint


def _draw_doc(pairs: DataFrame, seed: int) -> DataFrame:
    """One document per query."""
    pairs = pairs.select("qid", "docid").distinct()
    return pairs.groupBy("qid").agg(F.min_by("docid", hash_key(seed, "qid", "docid")).alias("docid"))


def _drawn_positives(run: DataFrame, queries: DataFrame, qrels: DataFrame, seed: int) -> DataFrame:
    judged = positives(qrels).join(run.select("qid"), "qid", "left_semi").join(queries, "qid", "left_semi")
    return _draw_doc(judged, seed)


def with_text(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    return (
        pairs.join(queries.select("qid", clean("query").alias("query")), "qid")
        .join(doc_contents(docs), "docid")
        .select(*pairs.columns, "query", "doc")
    )


def positive_ids(run: DataFrame, queries: DataFrame, qrels: DataFrame, docs: DataFrame, seed: int = 0) -> DataFrame:
    """One random positive (qid, docid) per query of the run; a drawn document without text loses the query."""
    return _drawn_positives(run, queries, qrels, seed).join(docs.select("docid"), "docid", "left_semi")


def negative_ids(
    run: DataFrame, chosen: DataFrame, docs: DataFrame, k: int = 5, seed: int = 0, exclude: DataFrame | None = None
) -> DataFrame:
    """One random candidate per query with a chosen positive, from its first k.

    Only the chosen positive is excluded, unless ``exclude`` gives other (qid, docid) pairs.
    """
    top = head_per_query(run, k).select("qid", "docid").join(chosen.select("qid"), "qid", "left_semi")
    left = minus(top, chosen, ["qid", "docid"])
    if exclude is not None:
        left = minus(left, exclude, ["qid", "docid"])
    return _draw_doc(left.join(docs.select("docid"), "docid", "left_semi"), seed)


def sample_positive(run: DataFrame, queries: DataFrame, qrels: DataFrame, docs: DataFrame, seed: int = 0) -> DataFrame:
    return with_text(positive_ids(run, queries, qrels, docs, seed), queries, docs)


def sample_negative(
    run: DataFrame, queries: DataFrame, qrels: DataFrame, docs: DataFrame,
    k: int = 5, seed: int = 0, exclude: str = "chosen",
) -> DataFrame:
    """One hard negative per query. ``exclude='judged'`` also rules out the other positives."""
    if exclude not in ("chosen", "judged"):
        raise ValueError(f"exclude must be 'chosen' or 'judged', not {exclude!r}")
    run = checkpoint(run.select("qid", "docid", "rank"))  # read twice
    chosen = positive_ids(run, queries, qrels, docs, seed)
    others = positives(qrels) if exclude == "judged" else None
    return with_text(negative_ids(run, chosen, docs, k, seed, others), queries, docs)


def pair_stats(
    run: DataFrame, queries: DataFrame, qrels: DataFrame, docs: DataFrame, k: int = 5, seed: int = 0
) -> DataFrame:
    """Queries of the run by status: kept, missing_data (no query or positive), missing_docs (no text)."""
    run = checkpoint(run.select("qid", "docid", "rank"))  # read three times
    drawn = checkpoint(_drawn_positives(run, queries, qrels, seed))
    chosen = drawn.join(docs.select("docid"), "docid", "left_semi")
    negative = negative_ids(run, chosen, docs, k, seed)
    status = F.when(F.col("_drawn").isNull(), "missing_data").when(F.col("_negative").isNull(), "missing_docs")
    return (
        run.select("qid").distinct()
        .join(drawn.select("qid", F.lit(1).alias("_drawn")), "qid", "left")
        .join(negative.select("qid", F.lit(1).alias("_negative")), "qid", "left")
        .groupBy(status.otherwise("kept").alias("status"))
        .agg(F.count("*").alias("queries"))
    )


def sample_n(df: DataFrame, n: int | Column, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly n rows, also where ``keys`` repeat; fails when there are fewer."""
    return first_by_hash(df, n, keys, seed, strict=True)


def shuffle(df: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    return df.orderBy(hash_key(seed, *keys))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("rows"))


def balanced_ids(
    relevant: DataFrame, non_relevant: DataFrame, n: int | None = None, seed: int = 0, keys: Sequence[str] = ("qid", "docid")
) -> DataFrame:
    """The ``keys`` and the label of n rows of each class, by default of as many as the scarcer class has."""
    wanted = n if n is not None else F.least(*[df.agg(F.count("*")).scalar() for df in (relevant, non_relevant)])
    parts = [
        sample_n(df.select(*keys), wanted, keys, seed).withColumn("label", F.lit(label))
        for df, label in ((relevant, 1), (non_relevant, 0))
    ]
    return union_aligned(*parts)


def balanced_prompts(
    relevant: DataFrame, non_relevant: DataFrame, n: int | None = None, seed: int = 0,
    keys: Sequence[str] = ("qid", "docid"),
) -> DataFrame:
    """n prompts of each class, by default as many as the scarcer class has: ``keys``, text and label, relevant ones
    labelled 1, in shuffled order."""
    wanted = n if n is not None else F.least(*[df.agg(F.count("*")).scalar() for df in (relevant, non_relevant)])
    parts = [
        sample_n(require_columns(df, "query", "doc"), wanted, keys, seed).select(
            *keys, point_prompt("query", "doc").alias("text"), F.lit(label).alias("label")
        )
        for df, label in ((relevant, 1), (non_relevant, 0))
    ]
    return shuffle(union_aligned(*parts), [*keys, "label"], seed)


def split_train_test(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 0, exact: bool = True
) -> DataFrame:
    """Mark each row 'test' or 'train'. The test part is the ceil(test_size * rows) smallest hashes, exactly; rows of
    one key can fall into both parts only at the cut.

    ``exact=False`` needs no count: each row goes by its own hash, so the sizes are only about right and rows of one
    key stay together.
    """
    if exact:
        marked = mark_first(df, lambda total: F.ceil(F.lit(float(test_size)) * total), keys, seed, "_test")
    else:
        marked = df.withColumn("_test", hash_number(seed, *keys) < int(test_size * 2**32))
    return marked.withColumn("part", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def _wanted_rank(seed: int, ranks: int) -> Column:
    return F.col("rank") == 1 + hash_number(seed, "qid") % ranks


def _triple_rows(
    run: DataFrame, queries: DataFrame, qrels: DataFrame, docs: DataFrame, seed: int, ranks: int
) -> DataFrame:
    """The run row at the drawn rank of each query, with the drawn positive and a status."""
    judged = positives(qrels).select("qid", "docid").distinct()
    drawn = _draw_doc(judged, seed).join(docs.select("docid"), "docid", "left_semi")
    rows = (
        run.where(_wanted_rank(seed, ranks))
        .select("qid", "docid")
        .join(queries.select("qid", F.lit(1).alias("_query")), "qid", "left")
        .join(drawn.withColumnRenamed("docid", "p_docid"), "qid", "left")
        .join(judged.withColumn("_judged", F.lit(1)), ["qid", "docid"], "left")
        .join(docs.select("docid", F.lit(1).alias("_doc")), "docid", "left")
    )
    missing = F.col("_query").isNull() | F.col("p_docid").isNull() | F.col("_doc").isNull()
    status = F.when(missing, "missing_data").when(F.col("_judged").isNotNull(), "docid_collision")
    return rows.select("qid", F.col("docid").alias("n_docid"), "p_docid", status.otherwise("kept").alias("status"))


def make_triples(
    run: DataFrame, queries: DataFrame, qrels: DataFrame, docs: DataFrame,
    n: int | None = None, seed: int = 0, ranks: int = 100,
) -> DataFrame:
    """(query, positive, negative) for all queries that give one, or for n of them taken in hash order.

    The negative is the candidate at a random rank, the positive a random judged document.
    """
    kept = _triple_rows(run, queries, qrels, docs, seed, ranks).where(F.col("status") == "kept")
    kept = kept.select("qid", "p_docid", "n_docid")
    if n is not None:
        kept = first_by_hash(kept, n, ["qid"], seed)

    def side(prefix: str, name: str) -> DataFrame:
        return docs.select(F.col("docid").alias(f"{prefix}_docid"), F.struct("docid", "url", "title", "body").alias(name))

    return (
        kept.join(queries.select("qid", "query"), "qid")
        .join(side("p", "pos"), "p_docid")
        .join(side("n", "neg"), "n_docid")
        .select("qid", "query", "pos", "neg")
    )


def flatten_triples(triples: DataFrame) -> DataFrame:
    """The ten columns of the triples file."""
    sides = [
        F.col(f"{side}.{name}").alias(f"{side[0]}_{name}")
        for side in ("pos", "neg")
        for name in ("docid", "url", "title", "body")
    ]
    return triples.select("qid", "query", *sides)


def triple_stats(
    run: DataFrame, queries: DataFrame, qrels: DataFrame, docs: DataFrame, seed: int = 0, ranks: int = 100
) -> DataFrame:
    """Run rows by status: skipped, missing_data, docid_collision, kept."""
    run = checkpoint(run.select("qid", "docid", "rank"))  # read twice
    drawn = _triple_rows(run, queries, qrels, docs, seed, ranks).select("status")
    skipped = run.where(~_wanted_rank(seed, ranks)).select(F.lit("skipped").alias("status"))
    return drawn.union(skipped).groupBy("status").agg(F.count("*").alias("rows"))


def pair_prompts(triples: DataFrame) -> DataFrame:
    """Each triple both ways round: (positive, negative) is 1, (negative, positive) is 0."""
    chunked = triples.select(
        first_chunk("query").alias("q"), first_chunk("pos.body").alias("p"), first_chunk("neg.body").alias("n")
    )
    both = F.array(
        F.struct(pair_prompt("q", "p", "n", "train").alias("text"), F.lit(1).alias("label")),
        F.struct(pair_prompt("q", "n", "p", "train").alias("text"), F.lit(0).alias("label")),
    )
    return chunked.select(F.inline(both))


def _selected_queries(qrels: DataFrame, top_k: int, max_pos: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Queries that give positives, and the rest."""
    judged = positives(qrels).select("qid").distinct()
    # Stored, as every later step reads it; fails on an empty table too.
    selected = checkpoint(first_by_hash(judged, min(max_pos, top_k), ["qid"], seed, strict=True))
    return selected, minus(judged, selected, ["qid"])


def _query_or_note(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    found = pairs.join(queries.select("qid", "query"), "qid", "left")
    return found.withColumn("query", F.coalesce("query", F.lit("Query not found")))


def qrels_positives(
    qrels: DataFrame, queries: DataFrame, docs: DataFrame, top_k: int, max_pos: int, seed: int = 0
) -> DataFrame:
    """Up to ``max_pos`` judged pairs with text, of min(max_pos, top_k) queries taken in hash order."""
    selected, _ = _selected_queries(qrels, top_k, max_pos, seed)
    pairs = positives(qrels).select("qid", "docid").distinct().join(selected, "qid", "left_semi")
    filled = docs.select("docid", clean("body").alias("doc")).where(F.col("doc") != "")
    kept = first_by_hash(pairs.join(filled.select("docid"), "docid", "left_semi"), max_pos, ["qid", "docid"], seed)
    return _query_or_note(kept, queries).join(filled, "docid").select(
        "qid", "docid", "query", "doc", F.lit(1).alias("relevance")
    )


def qrels_negative_ids(
    qrels: DataFrame, docs: DataFrame, top_k: int, max_pos: int, seed: int = 0
) -> DataFrame:
    """A random non-relevant document of the whole collection for up to ``top_k`` of the other queries.

    Documents stand in a ring in hash order. A query starts at a hashed place and takes the first document
    from there on that is not relevant to it. The step of that document is the smallest number that is no
    step of a relevant one, which is 0 or one more than such a step: an anti-join finds it.
    """
    _, others = _selected_queries(qrels, top_k, max_pos, seed)
    asking = checkpoint(first_by_hash(others, top_k, ["qid"], seed))
    ring = hash_position(docs.select("docid"), ["docid"], seed)
    starts = asking.withColumn("ring_size", docs.agg(F.count("*")).scalar()).withColumn(
        "start", hash_number(seed, "qid") % F.col("ring_size")
    )
    relevant = positives(qrels).select("qid", "docid").distinct().join(ring, "docid").join(starts, "qid")
    steps = relevant.select("qid", F.pmod(F.col("position") - F.col("start"), F.col("ring_size")).alias("step"))
    tries = starts.select("qid", F.lit(0).cast("bigint").alias("step")).union(
        steps.select("qid", F.col("step") + 1)
    )
    free = minus(tries, steps, ["qid", "step"]).groupBy("qid").agg(F.min("step").alias("step"))
    places = free.join(starts, "qid").where(F.col("step") < F.col("ring_size"))
    return places.select("qid", ((F.col("start") + F.col("step")) % F.col("ring_size")).alias("position")).join(
        ring, "position"
    ).select("qid", "docid")


def qrels_negatives(
    qrels: DataFrame, queries: DataFrame, docs: DataFrame, top_k: int, max_pos: int, seed: int = 0
) -> DataFrame:
    """The random negatives with text; one whose document is empty is left out."""
    ids = qrels_negative_ids(qrels, docs, top_k, max_pos, seed)
    filled = docs.select("docid", clean("body").alias("doc")).where(F.col("doc") != "")
    return _query_or_note(ids, queries).join(filled, "docid").select(
        "qid", "docid", "query", "doc", F.lit(0).alias("relevance")
    )


def qrels_pairs(
    qrels: DataFrame, queries: DataFrame, docs: DataFrame, top_k: int, max_pos: int, seed: int = 0
) -> DataFrame:
    return union_aligned(
        qrels_positives(qrels, queries, docs, top_k, max_pos, seed),
        qrels_negatives(qrels, queries, docs, top_k, max_pos, seed),
    )
