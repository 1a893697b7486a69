"""The learning queries hand the whole job to their operators."""
import pytest

from nearmiss.constants import E_ALL, NESTED_MODELS, P_CLEAN
from nearmiss.plans import learning as L


class Seen(Exception):
    pass


@pytest.fixture
def call(monkeypatch, spark):
    """Arguments with which a query first calls an operator of models.py."""
    table = spark.createDataFrame([(f"s{i}", i, 1.0 * i, 1, 0) for i in range(8)],
                                  "scenario_id string, time_index int, p_clean__focal_center_distance_m double, p_clean__focal_is_vehicle int, p_clean__focal_is_vulnerable int")
    monkeypatch.setattr(L, "development", lambda *_: (table, table))
    monkeypatch.setattr(L, "split_scores", lambda *_: (table, table, table))

    def run(query, operator):
        def stop(*args, **kw):
            raise Seen(args, kw)

        monkeypatch.setattr(L.ML, operator, stop)
        with pytest.raises(Seen) as e:
            getattr(L, query)(None, "")
        return e.value.args

    return run


@pytest.mark.parametrize("query, operator", [("nested_gbt", "score_nested"), ("negative_control", "negative_control"), ("threshold_sensitivity", "threshold_sensitivity"),
                                             ("feature_importance", "nested_gbt")])
def test_trees_have_the_full_settings(call, query, operator):
    args, kw = call(query, operator)
    assert not {"max_iter", "max_depth", "seeds", "taus"} & set(kw)
    if query == "nested_gbt":
        assert args[2] == NESTED_MODELS
    elif query == "negative_control":
        assert args[2:4] == (P_CLEAN, E_ALL) and kw["strata"] == ["kind", "band"]
        assert sorted(r.band for r in args[0].collect()) == [0, 0, 1, 1, 2, 2, 3, 3]
    else:
        assert NESTED_MODELS["M_P_Eall"] in args


def test_hurdle_and_censored_queries_fit_every_model(call, monkeypatch):
    for name in ("states", "map_points", "signals"):
        monkeypatch.setattr(L, name, lambda *_: None)
    monkeypatch.setattr(L.MT, "model_table", lambda *_: None)
    monkeypatch.setattr(L.MT, "r2_features", lambda *_: None)
    monkeypatch.setattr(L.ML, "prepare_r2", lambda *_: (None, None))
    assert call("hurdle_models", "train_hurdles") == ((None,), {})
    assert call("censored_coefficients", "fit_r2_suite") == ((None,), {})
