"""Registered queries against their SQL twins at the smallest scale.

By default one or two per kind; RELRANK_ALL=1 runs all of them, as verify.py does at any scale.
"""

import os

import pytest
from conftest import SMALL
from verify import compare, oracle, types

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


SOME = """
average_precision balanced_prompts batched_loss build_fair evaluate_by_query evaluate_classifier fair_dataset fairness_by_query file_stem first_chunk fit_logistic
head_per_query_runs map_run map_stats ndcg_tied pair_prompts_of_triples pair_stats qrels_negatives qrels_positives
rank_by_wins read_docs read_queries read_tsv rerank rerank_fair sample_n score_prompts set_ap_at_12 skip_queries
split_train_test triple_stats write_run
""".split()


@pytest.mark.parametrize("name", sorted(queries()) if os.environ.get("RELRANK_ALL") else SOME)
def test_query(spark, con, name):
    problem, _ = compare(spark, con, SMALL, name)
    assert problem == ""


def test_types(spark, con):
    for name in ("map_run", "evaluate_by_query", "fairness_by_query"):
        assert types(con, queries()[name](spark, SMALL), oracle_sql()[name]) == []


def test_entry(spark):
    assert entry(spark).count() == 3049


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
