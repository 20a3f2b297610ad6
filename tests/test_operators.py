"""Operators on small literals: null rules, ties, invariants."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from populace.functions import predicates as P
from populace.functions import responses as R
from populace.operators import cluster as C
from populace.operators import density as D
from populace.operators import gates as G
from populace.operators import geometry as H
from populace.operators import metrics as M
from populace.operators import perturb as T
from populace.operators import pool
from populace.plans.cascade import Step, cascade


def row_rule(text, row):
    """The predicate language, one row at a time."""
    if text == "ALL":
        return True
    for part in text.split("&"):
        part = part.strip()
        if "==" in part:
            c, v = (s.strip() for s in part.split("==", 1))
            ok = c in row and row[c] == v
        elif "!=" in part:
            c, v = (s.strip() for s in part.split("!=", 1))
            ok = c in row and row[c] != v
        elif " in " in part:
            c, v = (s.strip() for s in part.split(" in ", 1))
            ok = c in row and row[c] in [x.strip() for x in v.split(",")]
        else:
            ok = True
        if not ok:
            return False
    return True


ROWS = [{"a|b": x, "c d": y} for x in ("p", "q", None) for y in ("u", None)]


@pytest.mark.parametrize("text", ["ALL", "a|b == p", "a|b != p", "a|b in p,q & c d != u", "zz == p", "zz != p", "hm & c d == u", "a|b==p&c d in u"])
def test_predicates_follow_the_row_rule(spark, text):
    df = spark.createDataFrame([(r["a|b"], r["c d"]) for r in ROWS], "`a|b` string, `c d` string")
    got = df.where(P.compile_predicate(text, df.columns)).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in df.collect() if row_rule(text, r.asDict()))


def test_predicate_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("p", "u", 1)], "`a|b` string, `c d` string, v int")
    df.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = t.where(P.compile_predicate("a|b in p,q & c d == u", t.columns)).select("a|b")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "v#" not in plan.split("ReadSchema")[1][:80]


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.5, 1.0])
def test_deplete_drops_an_exact_count(spark, fraction):
    df = spark.createDataFrame([(i, "x" if i % 3 else None) for i in range(30)], "row_id long, label string")
    out = T.Deplete("label", ("x",), fraction)(df)
    assert out.count() == 30 - round(20 * fraction)
    assert out.where("label is null").count() == 10
    again = T.Deplete("label", ("x",), fraction)(df.repartition(3))
    assert {r["row_id"] for r in out.collect()} == {r["row_id"] for r in again.collect()}


def test_ratio_shift_never_upsamples(spark):
    df = spark.createDataFrame([(i, "a" if i < 20 else "b" if i < 24 else "c") for i in range(40)], "row_id long, label string")
    n = dict(T.RatioShift("label", {"a": 2, "b": 1, "zz": 9})(df).groupBy("label").count().collect())
    assert n == {"a": 8, "b": 4, "c": 16}


def test_scale_and_back_is_identity(spark):
    df = spark.createDataFrame([(float(v),) for v in np.linspace(-3, 6, 20)], "x double")
    out = T.Compose((T.ChannelScale({"x": 1.7}), T.ChannelScale({"x": 1 / 1.7})))(df).collect()
    assert np.allclose([r[0] for r in out], np.linspace(-3, 6, 20))


@pytest.mark.parametrize("spec", ["", "deplete c", "ratio_shift c", "ratio_shift c seed=1", "channel_shift x", "other y"])
def test_bad_specs_are_errors(spec):
    with pytest.raises(ValueError):
        T.parse_spec(spec)


def brute_gate(x, y, gates):
    """Largest area first, so that smaller and later ones overwrite."""
    flat = sorted(((c, g) for c, gs in gates.items() for g in (gs if isinstance(gs, list) else [gs])), key=lambda e: -e[1].area)
    out = "Unassigned"
    for c, g in flat:
        if g.x_min <= x <= g.x_max and g.y_min <= y <= g.y_max:
            out = c
    return out


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 6)] * 4), min_size=1, max_size=6))
def test_gates_match_brute_force(spark, boxes):
    gates = {f"g{i}": G.Rect(min(a, b), max(a, b), min(c, d), max(c, d)) for i, (a, b, c, d) in enumerate(boxes)}
    points = [(i, float(i % 7), float(i // 7)) for i in range(49)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    want = {i: brute_gate(x, y, gates) for i, x, y in points}
    assert dict(df.select("id", G.assign(F.col("x"), F.col("y"), gates)).collect()) == want
    t = spark.createDataFrame([(c, i, float(g.x_min), float(g.x_max), float(g.y_min), float(g.y_max)) for i, (c, g) in enumerate(gates.items())], "category string, ord int, x_min double, x_max double, y_min double, y_max double")
    assert {r["id"]: r["label"] for r in G.assign_by_table(df, t, "id", 2.0, 3.0).collect()} == want


def test_polygon_edges_are_inside(spark):
    square = G.Polygon(((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)))
    df = spark.createDataFrame([(0.0, 0.0), (4.0, 2.0), (2.0, 4.0), (2.0, 2.0), (4.1, 2.0), (-0.1, 0.0)], "x double, y double")
    assert [r[0] for r in df.select(square.contains(F.col("x"), F.col("y"))).collect()] == [True] * 4 + [False] * 2


def test_metrics_by_hand(spark):
    rows = [("A", "A")] * 3 + [("A", "B")] + [("B", "B")] * 2 + [("U", "A")] * 2
    counts = M.confusion(spark.createDataFrame([(1, *r) for r in rows], "t int, gt string, pred string"), ["t"])
    listed = spark.createDataFrame([(1, "A"), (1, "B"), (1, "Z")], "t int, label string")
    r = M.task_metrics(counts, listed, ["t"]).first()
    assert r["n_cells"] == 8 and r["accuracy"] == 0.625
    assert r["balanced_accuracy"] == round((0.75 + 1 + 0) / 3, 4)
    assert r["f1_macro"] == round((6 / 9 + 0.8 + 0) / 3, 4)
    assert counts.agg(F.sum("n")).first()[0] == 8


def test_metrics_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "t int, gt string, pred string")
    assert M.task_metrics(M.confusion(empty, ["t"]), spark.createDataFrame([], "t int, label string"), ["t"]).count() == 0


def test_majority_prefers_listed_order(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "zz"), (3, "b")], "k int, label string")
    assert dict(M.majority(df, ["k"], "label", ["a", "b"]).collect()) == {1: "a", 2: None, 3: "b"}


def test_hull_area_and_overlap():
    square = H.hull(np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)]))
    assert H.area(square) == 4
    moved = H.hull(np.array([(1, 0), (3, 0), (3, 2), (1, 2)]))
    assert math.isclose(H.overlap_ratio(square, moved), 1 / 3)
    assert math.isclose(H.overlap_ratio(square, square), 1.0)
    assert H.hull(np.array([(0, 0), (1, 1), (2, 2)])) is None
    assert H.overlap_ratio(None, square) is None and H.overlap_ratio(square, None) == 0


def test_best_rectangle_finds_a_block():
    g, o = np.zeros((10, 10)), np.zeros((10, 10))
    g[2:5, 3:8] = 5
    o[6:, :] = 3
    assert H.best_rectangle(g, o) == (1.0, (2, 4, 3, 7))


def test_peaks_and_basins():
    c = np.zeros((30, 30))
    c[5:8, 5:8] = 50
    c[20:23, 21:24] = 40
    peaks = D.joint_peaks(c)
    assert [(p[0], p[1]) for p in peaks[:2]] == [(6, 6), (21, 22)]
    lab = D.watershed(c, peaks)
    assert lab[6, 6] == 1 and lab[21, 22] == 2 and set(np.unique(lab)) == set(range(1, len(peaks) + 1))
    assert len(D.spanning_valleys(c, peaks)) == len(peaks) - 1


def test_connected_components_of_a_mask():
    lab, n = D.connected(np.array([[1, 1, 0], [0, 0, 0], [1, 0, 1]], bool))
    assert n == 3 and lab[0, 0] == lab[0, 1] != lab[2, 0]


def test_clusters():
    x = np.concatenate([np.random.default_rng(0).normal(m, 0.1, (30, 2)) for m in (0, 5, 9)])
    assert len(C.kmeans(x, 3)) == 3
    for how in ("average", "ward"):
        lab = C.agglomerate(x, 3, how)
        assert [len(set(lab[i : i + 30])) for i in (0, 30, 60)] == [1, 1, 1] and len(set(lab)) == 3
    assert (C.agglomerate(x[:4], 9) == np.arange(4)).all()


def test_answers():
    assert R.objects('a {"x": "}"} {"y": {"z": 1}}') == ['{"x": "}"}', '{"y": {"z": 1}}']
    assert R.best_object('{"q": 1} {"a": 1, "b": 2} {"a": 3}', ["a", "b"]) == {"a": 1, "b": 2}
    assert R.best_object("none", ["a"]) is None


def test_cascade_matches_one_row_at_a_time(spark):
    steps = [Step("s1", "ALL", "x", "x", {"hi": G.Rect(5, 10, 0, 10), "lo": G.Rect(0, 5, 0, 10)}), Step("s2", "s1 == hi", "x", "x", {"top": G.Rect(8, 10, 0, 10)})]
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    got = {r["x"]: (r["s1"], r["s2"]) for r in cascade(df, steps, cut_every=1).collect()}
    assert got[3.0] == ("lo", "Unassigned") and got[9.0] == ("hi", "top") and got[6.0] == ("hi", "Unassigned")


def test_merge_needs_all_shards(spark):
    df = spark.createDataFrame([(1, 0, 2), (2, 1, 2)], "k int, shard int, n_shards int")
    assert pool.merge_shards(df, ["k"], 2).count() == 2
    with pytest.raises(ValueError):
        pool.merge_shards(df, ["k"], 3)
    with pytest.raises(ValueError):
        pool.merge_shards(df.union(df), ["k"], 2)


def test_longest_first_balances():
    out = pool.longest_first([("a", 9), ("b", 5), ("c", 4), ("d", 1)], 2)
    assert out["a"] != out["b"] and out["b"] == out["c"]


def test_half_floats_are_widened(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from populace.sources.files import scan_wide_floats

    pq.write_table(pa.table({"x": pa.array(np.array([1.5, 2.5], np.float16)), "s": ["a", None]}), tmp_path / "h.parquet")
    assert [tuple(r) for r in scan_wide_floats(spark, str(tmp_path)).collect()] == [(1.5, "a"), (2.5, None)]


def test_agent_loop_calls_a_tool_first():
    from populace.operators.remote import call, dialogue  # noqa: F401

    turns = iter([{"tool": "look", "args": {}}, {"text": "done"}])
    out = dialogue("p", lambda h, more: next(turns), {"look": lambda a: "seen"})
    assert out["answer"] == "done" and out["tools"] == ["look"]


def test_retries(spark):
    from populace.operators.remote import call

    def fails(_):
        raise OSError

    r = call(spark.createDataFrame([("k", "p")], "key string, prompt string"), fails, 2, 0.0).first()
    assert (r["answer"], r["attempts"], r["status"]) == (None, 2, "failed: OSError")


def test_hull_of_batches_is_the_hull(spark):
    p = np.random.default_rng(2).normal(size=(500, 2))
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in p] + [("b", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 0.0)], "g string, x double, y double").repartition(5)
    got = {r["g"]: np.array([(q["x"], q["y"]) for q in r["points"]]) for r in H.hull_points(df, ["g"], "x", "y").collect()}
    assert math.isclose(H.area(H.hull(got["a"])), H.area(H.hull(p))) and len(got["b"]) >= 2 and len(got["c"]) == 1


@pytest.mark.parametrize("rank", [0, 1, 17, 50, 60])
def test_ranked_split_is_exact(spark, rank):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "row_id long, c string")
    low, high = T.split_by_rank(df, F.col("c"), "row_id", 5, {"a": rank})
    order = [r[0] for r in df.where("c = 'a'").orderBy(T.seeded_order(F.col("row_id"), 5)).collect()]
    assert {r[0] for r in low.collect()} == set(order[:rank]) and {r[0] for r in high.collect()} == set(order[rank:])


def test_clouds_are_born_merge_and_end():
    c = np.zeros((30, 20))
    c[3:8, 3:8] = 20
    c[5, 5] = 60
    c[18:23, 10:15] = 15
    c[20, 12] = 50
    c[28, 18] = 3
    found = D.level_clouds(c)
    assert [(m.xb, m.yb) for m in found] == [(5, 5), (20, 12)] and all(m.birth == 9 for m in found)
    basin = D.watershed(c, [(m.xb, m.yb) for m in found])
    assert (basin[3:8, 3:8] == 1).all() and (basin[18:23, 10:15] == 2).all() and (basin > 0).all()
    assert D.level_clouds(np.zeros((4, 4))) == [] and (D.watershed(c, []) == 0).all()


def test_clusters_are_fitted_in_full(spark, sf, monkeypatch):
    """All components, and the operators' own map, rounds and limit."""
    from populace.operators import cluster as C
    from populace.queries import analysis

    met = []
    for name in ("flowsom", "cluster_plane"):
        real = getattr(C, name)
        monkeypatch.setattr(C, name, lambda rows, columns, key, *a, _f=real, **b: met.append((len(columns), len(a), b)) or _f(rows, columns, key, *a, **b))
    slots = analysis.flowsom(spark, sf).collect()
    analysis.plane_ward(spark, sf), analysis.plane_gmm(spark, sf)
    assert met == [(64, 1, {}), (2, 2, {}), (2, 2, {})]
    assert sum(r["n"] for r in slots) == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_remote_calls_take_every_event(spark, sf):
    from populace.queries import texts

    assert texts.remote_calls(spark, sf).where("status = 'ok'").count() == spark.read.parquet(f"{sf}/events.parquet").count() > 40


def walked_clouds(counts, levels=9, share=0.005, least=50):
    """Masks level by level, and every tenant of every set looked at anew."""
    s, g = D.gaussian(np.log1p(counts), 1.5), D.log_levels(counts, levels)
    need, modes = max(int(share * counts.sum()), least), []
    for k in range(levels, 0, -1):
        lab, n = D.connected(g >= k)
        for c in range(1, n + 1):
            rows = int(counts[lab == c].sum())
            inside = sorted((m for m in modes if m["alive"] and lab[m["at"]] == c), key=lambda m: -m["height"])
            if not inside:
                p = np.argwhere(lab == c)
                at = tuple(int(v) for v in p[np.argmax(s[lab == c])])
                modes.append({"at": at, "height": float(s[at]), "birth": k, "alone": rows, "death": None, "alive": True})
            elif len(inside) == 1:
                inside[0]["alone"] = max(inside[0]["alone"], rows)
            for m in inside[1:]:
                m["alive"] = m["alone"] >= need
                for e in [m] + [inside[0]] * m["alive"]:
                    e["death"] = e["death"] or k + 1
    left = sorted((m for m in modes if m["alive"] and m["alone"] >= need), key=lambda m: -m["height"])
    return [(*m["at"], m["height"], m["birth"], m["alone"], m["death"]) for m in left]


@pytest.mark.parametrize("seed", range(25))
def test_clouds_match_a_level_by_level_walk(seed):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal(rng.uniform(0, 40, 2), rng.uniform(1, 4), (rng.integers(100, 900), 2)) for _ in range(rng.integers(1, 6))])
    counts, *_ = np.histogram2d(*points.T, bins=(48, 24), range=((0, 40), (0, 40)))
    least = int(rng.integers(1, 80))
    assert [(m.xb, m.yb, m.height, m.birth, m.alone, m.death) for m in D.level_clouds(counts, least=least)] == walked_clouds(counts, least=least)


def test_levels_count_cuts_at_or_below():
    c = np.array([[0, 1, 1, 1], [1, 2, 2, 8]], float)
    s = np.log1p(c)
    cuts = np.quantile(s[c > 0], [0.25, 0.5, 0.75])
    assert D.log_levels(c, 4).tolist() == [[0 if not n else 1 + sum(q <= v for q in cuts) for n, v in zip(a, b)] for a, b in zip(c, s)]
    assert D.log_levels(c, 4)[1, 3] == 4 and D.log_levels(c, 4)[0, 1] == 3


def test_ward_weighs_points_by_their_rows():
    x = np.array([[0.0], [1.0], [2.2]])
    assert C.agglomerate(x, 2, "ward").tolist() == [0, 0, 1]
    assert C.agglomerate(x, 2, "ward", np.array([100, 100, 1])).tolist() == [0, 1, 1]


def test_an_edge_maximum_keeps_real_peaks(spark):
    heights = [5.0, 4.0, 0.1, 1.0, 0.1, 0.9, 0.1]
    grid = spark.createDataFrame([(i, float(np.expm1(h))) for i, h in enumerate(heights)], "i int, density double")
    got = sorted(tuple(r[:2]) for r in D.peaks_and_valleys(grid, 1).collect())
    assert got == [("peak", 3), ("peak", 5), ("valley", 4)]
