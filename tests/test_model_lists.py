"""Which models and cells the experiment queries evaluate: all that the operator has."""

import pytest

from flowlens.operators import audit
from flowlens.operators.models import MODELS, OPTIONAL_MODELS
from flowlens.plans import QUERIES, q_models

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize(("name", "cells"), [("transfer_eval", 6), ("external_eval", 2), ("observability_ablation", 10)])
def test_queries_evaluate_every_cell_and_model(spark, monkeypatch, name, cells):
    def seen(spark, found):
        raise Seen(found)

    monkeypatch.setattr(q_models, "evaluate", seen)
    no_report = spark.createDataFrame([], "dataset string, feature string, single_feature_macro_f1 double")
    monkeypatch.setattr(audit, "single_feature_scores", lambda *a, **b: None)
    monkeypatch.setattr(audit, "audit_report", lambda *a, **b: no_report)
    with pytest.raises(Seen) as got:
        QUERIES[name](spark, SF)
    assert len(got.value.args[0]) == cells and all(tuple(c.models) == MODELS for c in got.value.args[0])


@pytest.mark.parametrize(("name", "runner", "models"), [("model_grid_multiclass", "run_grid", [*MODELS, *OPTIONAL_MODELS]), ("family_ablation", "family_ablation", list(MODELS))])
def test_grids_run_every_model(spark, monkeypatch, name, runner, models):
    def seen(*args, **named):
        raise Seen([list(a) for a in args if isinstance(a, (list, tuple)) and MODELS[0] in a][0])

    monkeypatch.setattr(q_models, runner, seen)
    with pytest.raises(Seen) as got:
        QUERIES[name](spark, SF)
    assert got.value.args[0] == models
