from types import SimpleNamespace

from pulsegrid.plans import catalog, ml


def test_registered_models_have_the_sizes_of_the_reference(monkeypatch):
    seen = {}

    def segments(features, ks=ml.segments.__defaults__[0]):
        seen["ks"] = ks

    def churn(features, trees=ml.churn.__defaults__[0], depth=ml.churn.__defaults__[1]):
        seen["churn"] = (trees, depth)
        return SimpleNamespace(scores=None)

    def features(sessions, users, away_days=ml.churn_features.__defaults__[0]):
        seen["away"] = away_days

    for name, f in (("segments", segments), ("churn", churn), ("churn_features", features), ("segment_features", lambda *x: None)):
        monkeypatch.setattr(ml, name, f)
    tables = SimpleNamespace(freq=None, power=None, u=None, s=None)
    for name in ("kmeans_segments", "churn_scores"):
        catalog.QUERIES[name][0](tables)
    assert seen == {"ks": (3, 4, 5, 6, 7), "churn": (50, 5), "away": 30}


def test_forecast_boosts_fifty_rounds(spark, monkeypatch):
    rounds = []
    real = ml.GBTRegressor
    monkeypatch.setattr(ml, "GBTRegressor", lambda **k: rounds.append((k["maxIter"], k["maxDepth"])) or real(**{**k, "maxIter": 2}))
    rows = [(f"2024-01-{d:02d}", 100 + d, 1.0, 0.6 + d / 100, 0.5, 0.4, 0.2 + d / 200) for d in range(1, 16)]
    ml.forecast(spark.createDataFrame(rows, "cohort_week string, cohort_size long, week_0 double, week_1 double, week_2 double, week_4 double, week_12 double"))
    assert rounds == [(50, 4)]
