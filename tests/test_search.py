"""The registered search and sweep cover all their settings."""
from apexgrid.catalog import learning as L, registry
from apexgrid.plans import models as M


def test_search_draws_all_settings(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(L, "_split", lambda v: (None, None))
    monkeypatch.setattr(M, "search", lambda train, cols, specs: asked.extend(specs) or spark.range(1))
    registry.QUERIES["ml08_random_search"](spark, "/root/testdata/sf0.001")
    assert len(asked) == M.SEARCH_DRAWS + 1 and asked[0] == M.SPECS["v2"]


def test_sweep_compares_all_sensitivities_and_optimizers(spark):
    rows = registry.QUERIES["evl09_config_comparison"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["config_id"], r["optimizer"], r["sensitivity"]) for r in rows) == sorted(L.SWEEP) and len(rows) == 9 * 4
    assert {r["optimizer"] for r in rows} == {"greedy", "upgraded", "exact", "sampled"} and {r["sensitivity"] for r in rows} == {0, 1, 2, 3, 5, 8, 10, 15, 20}
