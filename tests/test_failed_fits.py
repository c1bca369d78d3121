"""A registered query fails when one of its models does; it returns no table without that model."""

import pytest

from laggard.operators import train
from laggard.plans import catalog


@pytest.fixture
def one_fails(monkeypatch):
    real = train.fit_model

    def fit(name, frame, mode="pre_exec", **sizes):
        if name == "lightgbm":
            raise MemoryError("no memory")
        return real(name, frame, mode, **{**sizes, "rounds": 2, "trees": 3})

    monkeypatch.setattr(train, "fit_model", fit)


@pytest.mark.parametrize("name", ["early_exec_model", "trained_evaluation", "transfer_matrix"])
def test_a_query_fails_with_its_model(spark, small, one_fails, name):
    with pytest.raises(RuntimeError, match="lightgbm could not be fitted: no memory"):
        catalog.QUERIES[name](spark, small).collect()
