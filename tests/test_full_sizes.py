"""The registered training queries ask for all four models at their full sizes."""

import inspect

import pytest

from laggard.functions.scoring import MODELS
from laggard.operators import train
from laggard.plans import catalog, pipeline


class Asked(Exception):
    pass


@pytest.mark.parametrize("name, module, function, names", [
    ("fit_rf", train, "train_models", ["random_forest"]), ("fit_gbt_a", train, "train_models", ["xgboost"]),
    ("fit_gbt_b", train, "train_models", ["lightgbm"]), ("trained_evaluation", train, "train_models", MODELS),
    ("cross_validation", train, "cross_validate", MODELS), ("early_exec_model", train, "train_models", MODELS),
    ("transfer_matrix", pipeline, "transfer_matrix", MODELS), ("feature_importance", train, "fit_model", None),
])
def test_full_sizes(spark, small, monkeypatch, name, module, function, names):
    signature = inspect.signature(getattr(module, function))

    def record(*args, **kwargs):
        asked = signature.bind(*args, **kwargs)
        asked.apply_defaults()
        raise Asked(asked.arguments)

    monkeypatch.setattr(module, function, record)
    with pytest.raises(Asked) as caught:
        catalog.QUERIES[name](spark, small)
    asked = caught.value.args[0]
    sizes = {**asked, **asked.get("training", {}), **asked.get("sizes", {})}
    assert sizes.get("rounds") is None and sizes.get("trees") is None
    assert names is None or list(asked["names"]) == list(names)
