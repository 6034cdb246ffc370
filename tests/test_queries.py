"""What the registered queries show: every verdict column takes more than one value on the small tables."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.01"
#: Queries and their columns of verdicts.
VERDICTS = {
    "policy_evaluate_point": ("reasons", "dominators", "rank"), "memory_bundle": ("value", "eligible_runs"), "cost_basis_combine": ("basis",),
    "terminal_leaderboard": ("verdict",), "signal_units": ("unit",), "corpus_wer": ("rate",), "documents_verified": ("rule",), "canonical_texts": ("canonical",),
    "bootstrap_draws": ("low",), "formula_functions": ("divided", "large"),
}


@pytest.mark.parametrize("name", VERDICTS)
def test_verdicts_vary(spark, name):
    rows = __spark_entry__.queries()[name](spark, SF).select(*VERDICTS[name]).collect()
    for column in VERDICTS[name]:
        assert len({r[column] for r in rows}) > 1, column
    assert name in __spark_entry__.oracle_sql()
