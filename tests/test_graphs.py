"""Document patches, reachability and draw summaries."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline import actions
from tideline.operators import graphs, identification, posterior, simulate

values = st.one_of(st.none(), st.integers(0, 2), st.text("ab", max_size=2), st.lists(st.integers(0, 1), max_size=2))


def entity(draw_null):
    """An entity's fields are always there; only their values differ."""
    plain = st.fixed_dictionaries({"kind": st.sampled_from(["x", "y"]), "size": values, "distribution": st.sampled_from(["Normal", "Beta", "distribution:1"])})
    return st.one_of(plain, draw_null)


documents = st.fixed_dictionaries({"note": values, "nested": st.fixed_dictionaries({"a": values}), "constructs": st.dictionaries(st.sampled_from("abc"), entity(st.integers(0, 1)), max_size=3)})


@given(documents, documents)
def test_a_diff_rebuilds_the_document(a, b):
    assert graphs.merge(a, graphs.diff(a, b)) == b and graphs.diff(a, a) == {}


def test_null_deletes_entities_only():
    before = {"note": 1, "constructs": {"a": {"p": 1}, "b": {"p": 2}}}
    assert graphs.merge(before, {"note": None, "constructs": {"a": None, "b": {"p": None}}}) == {"note": None, "constructs": {"b": {"p": None}}}
    assert graphs.diff(before, {"note": None, "constructs": {"b": {"p": 2}}}) == {"note": None, "constructs": {"a": None}}


def test_another_distribution_replaces_whole():
    law = {"distribution": "Normal", "mu": 0, "sigma": 1}
    assert graphs.merge({"prior": law}, {"prior": {"distribution": "Beta", "a": 2}}) == {"prior": {"distribution": "Beta", "a": 2}}
    assert graphs.merge({"prior": law}, {"prior": {"distribution": "distribution:7"}})["prior"]["mu"] == 0


def test_content_hash_ignores_the_order_of_keys():
    one, two = {"b": [1, {"y": None, "x": "é"}], "a": 2}, {"a": 2, "b": [1, {"x": "é", "y": None}]}
    assert graphs.content_hash(one) == graphs.content_hash(two) != graphs.content_hash({"a": 2, "b": []})


def test_instruments_are_no_descendants_of_the_treatment(spark):
    e = lambda *pairs: spark.createDataFrame(pairs, "cause string, effect string")
    seen = spark.createDataFrame([(x,) for x in "XYZW"], "node string")
    found = lambda edges: {r.node for r in graphs.instruments(edges, seen, "X", "Y").collect()}
    assert found(e(("X", "Y"), ("Z", "X"))) == {"Z"}
    assert found(e(("X", "Y"), ("Z", "X"), ("X", "Z"))) == set()
    assert found(e(("X", "Y"), ("Z", "X"), ("Z", "Y"))) == set()
    assert found(e(("X", "Y"), ("Z", "X"), ("W", "Z"), ("W", "Y"))) == set()


def test_orphans_go():
    model = {
        "constructs": {"a": {}, "b": {}},
        "edges": {"e1": {"cause": "a", "effect": "b", "weight": "p1"}, "e2": {"cause": "c", "effect": "b", "weight": "p2"}},
        "indicators": {"i": {"construct": "c"}, "j": {"construct": "a"}},
        "parameters": {"p1": {"distribution": "distribution:1"}, "p2": {"distribution": "distribution:2"}},
        "distributions": {"distribution:1": {"distribution": "Normal"}, "distribution:2": {"distribution": "Normal"}},
    }
    out = actions.edit_model(model, {"edges": {"e1": {"label": "x"}}})
    assert set(out["edges"]) == {"e1"} and set(out["indicators"]) == {"j"} and set(out["parameters"]) == {"p1"} and set(out["distributions"]) == {"distribution:1"}
    assert actions.edit_question({"outcome": "a"}, {"text": None}) == {"outcome": "a", "text": None}
    with pytest.raises(ValueError):
        actions.edit_question({"outcome": "a"}, {"outcome": None})


def test_interventions():
    assert simulate.levels("constant", 5, 1.0, 1.0, 2.0, 1.0, 3.0).tolist() == [1, 3, 3, 1, 1]
    assert simulate.levels("ramp", 5, 1.0, 0.0, 4.0, 1.0, 3.0).tolist() == [0, 0, 2, 4, 4]
    assert simulate.levels("precomputed", 4, 1.0, 1.0, [0.5, 2.0]).tolist() == [1.5, 3, 3, 3]
    assert [simulate.batch_width(n, 10, 100) for n in (7, 10, 11, 100, 0)] == [7, 10, 6, 7, 1] and simulate.batch_width(5, 1000, 1) == 1


def test_identification_of_known_graphs():
    told = lambda edges, seen, t, o: identification.effects([tuple(e.split(">")) for e in edges.split()], seen, [(t, o)])[0][2]
    assert told("X>Y", "XY", "X", "Y") and told("Y>X", "XY", "X", "Y")
    assert not told("X>Y U>X U>Y", "XY", "X", "Y")  # the bow
    assert told("X>M M>Y U>X U>Y", "XMY", "X", "Y")  # the front door
    assert not told("X>M M>Y U>X U>Y V>M V>Y", "XMY", "X", "Y")
    assert told("Z>X Z>Y X>Y", "XYZ", "X", "Y")  # the back door
    assert not told("Z>X X>Y U>X U>Y", "XYZ", "X", "Y")  # an instrument alone tells no law
    assert told("X>H H>Y", "XY", "X", "Y") and not told("X>H H>Y U>X U>H", "XY", "X", "Y")
    assert told("W>X X>Y U>W U>Y V>W V>X", "WXY", "W", "X") is False and told("A>X X>Y U>A U>Y", "AXY", "X", "Y")
    directed, two_way = identification.projected([("X", "H"), ("H", "Y"), ("H", "Z")], set("XYZ"))
    assert directed == {("X", "Y"), ("X", "Z")} and two_way == {frozenset("YZ")}


def test_redundant_coefficients():
    assert graphs.redundant_coefficients([{"a": 1, "b": 1}, {"c": 1}]) == [("a", "b")]
    assert graphs.redundant_coefficients([{"a": 1, "b": 1}, {"a": 1}]) == []
    assert graphs.redundant_coefficients([{"a": 1, "b": 2}, {"a": 2, "b": 4, "c": 0}, {"d": 1, "e": -1}, {"d": 3, "e": 1}]) == [("a", "b")]


def test_a_changed_kind_replaces():
    assert graphs.merge({"x": {"kind": "a", "p": 1}}, {"x": {"kind": "b", "q": 2}}) == {"x": {"kind": "b", "q": 2}}
    assert graphs.flatten({"a": {"b": 1, "c": {}}}) == {"/a/b": "1", "/a/c": "{}"}


def test_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "cause string, effect string")
    assert {r.node for r in graphs.ancestors(e, "a").collect()} == {"b", "c", "d"}


def test_effective_sample_size(spark):
    rng = np.random.default_rng(0)
    rows = [("iid", c, i, float(x)) for c in range(4) for i, x in enumerate(rng.normal(size=500))]
    rows += [("frozen", c, i, 1.0) for c in range(4) for i in range(500)]
    out = {r.param: r.ess for r in posterior.ess(spark.createDataFrame(rows, "param string, chain int, draw int, value double")).collect()}
    assert out["frozen"] == 0 and out["iid"] > 1000


def test_effective_sample_size_counts_every_draw(spark):
    """Short chains beside long ones neither cut nor replace them."""
    rng = np.random.default_rng(1)
    long = [rng.normal(size=800) for _ in range(4)]
    rows = [(p, c, i, float(x)) for p in ("even", "ragged", "single") for c, d in enumerate(long) for i, x in enumerate(d)]
    rows += [("ragged", 9, i, float(x)) for i, x in enumerate(rng.normal(size=7))] + [("single", 9, 0, 0.1)]
    out = {r.param: r.ess for r in posterior.ess(spark.createDataFrame(rows, "param string, chain int, draw int, value double")).collect()}
    assert all(2400 < out[p] < 4200 for p in ("even", "ragged", "single"))
    # Draws in the middle of a long chain count: a jump there, of one chain, is seen.
    moved = [(p, c, i, v + (3.0 if c == 0 and 100 < i < 700 else 0.0)) for p, c, i, v in rows if p == "ragged"]
    out = posterior.ess(spark.createDataFrame(moved, "param string, chain int, draw int, value double")).first()
    assert out.ess < 400


def test_effective_sample_size_of_even_chains_is_as_defined():
    """Equal halves: the plain split estimator."""
    x = np.cumsum(np.random.default_rng(2).normal(size=(6, 50)), 1) * 0.1 + np.random.default_rng(3).normal(size=(6, 50))
    n = x.shape[1]
    c = x - x.mean(1, keepdims=True)
    acov = np.array([[(r[: n - t] * r[t:]).sum() / n for t in range(n)] for r in c]).mean(0) * n / (n - 1)
    rho = 1 - (acov[0] - acov) / (acov[0] * (n - 1) / n + x.mean(1).var(ddof=1))
    rho[0] = 1
    pairs = rho.reshape(-1, 2).sum(1)
    pairs = np.minimum.accumulate(pairs[: (pairs <= 0).argmax() if (pairs <= 0).any() else None])
    assert abs(posterior._ess(list(x)) - x.size / (2 * pairs.sum() - 1)) < 1e-6


def test_verdicts_see_spread_and_heavy_tails(spark):
    """Chains that agree in mean but not in spread; Cauchy chains that are apart."""
    rng = np.random.default_rng(5)
    rows = [("same", c, i, float(x)) for c in range(4) for i, x in enumerate(rng.normal(size=500))]
    rows += [("spread", c, i, float(x)) for c in range(4) for i, x in enumerate(rng.normal(scale=1 + 3 * (c == 0), size=500))]
    rows += [("heavy", c, i, float(x)) for c in range(4) for i, x in enumerate(rng.standard_cauchy(size=500) + 2 * (c == 0))]
    rows += [("frozen", c, i, 1.0) for c in range(4) for i in range(500)] + [("same", 9, 0, 0.1)]
    df = spark.createDataFrame(rows, "param string, chain int, draw int, value double")
    found = posterior.rank_diagnostics(df).withColumn("ess", F.least("ess_bulk", "ess_tail")).cache()
    out = {r.param: r for r in found.collect()}
    plain = {r.param: r.rhat for r in posterior.rhat(df.filter("param = 'spread' OR param = 'heavy'")).collect()}
    assert max(plain.values()) < 1.05 <= min(out["spread"].rhat, out["heavy"].rhat)
    assert out["same"].rhat < 1.01 and 1000 < out["same"].ess_bulk and 1000 < out["same"].ess_tail
    assert {r.param: r.outcome for r in posterior.verdicts(found, 4).collect()} == {"same": "passed", "spread": "failed", "heavy": "failed", "frozen": "not_evaluated"}


def test_loo_totals(spark):
    rng = np.random.default_rng(6)
    rows = [(p, i, float(x)) for p in range(5) for i, x in enumerate(rng.normal(-1, 0.3, 400))] + [(9, i, -float(x)) for i, x in enumerate(rng.pareto(1.5, 400))]
    df = spark.createDataFrame(rows, "point long, draw int, log_lik double")
    points = posterior.psis_loo(df).toPandas()
    out = posterior.loo_totals(df).first()
    ll = np.array([[v for q, _, v in rows if q == p] for p in points["point"]])
    assert abs(out.elpd_loo - points["elpd"].sum()) < 1e-9 and abs(out.se - np.sqrt(6 * points["elpd"].var(ddof=0))) < 1e-9
    assert abs(out.p_loo - (np.log(np.exp(ll).mean(1)).sum() - points["elpd"].sum())) < 1e-6
    assert out.n == 6 and out.n_bad_k == (points["pareto_k"] > 0.7).sum() > 0 and out.n_warn_k == points["pareto_k"].between(0.5, 0.7, "right").sum()


@pytest.mark.parametrize("partitions", [1, 3])
def test_simulation_does_not_depend_on_partitions(spark, partitions):
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", partitions)
    out = simulate.simulate(spark, 4, 10, shift=1.0).toPandas().sort_values(["arm", "draw", "time"])
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert abs(out["value"].sum() - simulate.simulate(spark, 4, 10, shift=1.0).toPandas()["value"].sum()) < 1e-9
