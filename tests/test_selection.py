import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from farspread.functions import config, identity, species
from farspread.operators import box
from farspread.operators.fps import as_matrix, fps, greedy
from farspread.operators.ordering import quota
from farspread.sources import xyz
from farspread.functions.errors import ScanError


def brute(x, n, seed=None):
    held = [] if seed is None else list(seed)
    picks = [] if held else [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    while len(picks) < min(n, len(x)):
        d = np.array([-1 if i in picks else min(((x[i] - s) ** 2).sum() for s in [*held, *x[picks]]) for i in range(len(x))])
        if picks and d.max() <= 0:
            break
        picks.append(int(d.argmax()))
    return picks


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 14), st.booleans(), st.integers(0, 10**6))
def test_greedy_matches_brute_force(rows, n, seeded, random):
    rng = np.random.default_rng(random)
    x = rng.integers(0, 4, (rows, 2)).astype(float)
    seed = rng.integers(0, 4, (3, 2)).astype(float) if seeded else None
    p = greedy(x, n, seed)
    assert p.indices.tolist() == brute(x, n, seed)
    assert len(set(p.indices.tolist())) == len(p.indices)
    assert (p.reason is None) == (len(p.indices) == n)


def test_edge_cases():
    assert greedy(None, 3).reason == "exhausted"
    assert greedy(np.zeros((2, 1)), 0).reason is None
    assert greedy(np.zeros((3, 2)), 3).indices.tolist() == [0]
    assert greedy(np.array([[0.0], [1.0], [1.1]]), 3, min_dist2=0.5).reason == "min_dist_stop"
    with pytest.raises(ValueError):
        as_matrix([[float("nan")]])


def frame(spark, x, first=0, step=1):
    return spark.createDataFrame([(first + step * i, [float(v) for v in r]) for i, r in enumerate(x)], "pos long, features array<double>")


def order(picks):
    return [(r.pos, r.score) for r in picks.orderBy("rank").collect()]


def test_picks_do_not_depend_on_the_strategy(spark, monkeypatch):
    from farspread.operators import fps as module

    monkeypatch.setattr(module, "FETCHED", 7)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (50, 2)).astype(float)  # many ties and equal rows
    df, seed = frame(spark, x, 3, 10), frame(spark, rng.integers(0, 5, (4, 2)))
    for options in ({"init": "index:7"}, {"init": "index:-1"}, {"init": "random", "random_state": 5}, {}, {"min_dist2": 3.0}, {"allow_zero": True}, {"seed": seed}, {"seed": seed, "min_dist2": 2.0}):
        one = order(fps(df, 40, **options))
        assert one == order(fps(df.repartition(3), 40, budget=0, **options)), options
    assert order(fps(df, 1, init="index:7"))[0][0] == 73
    assert fps(df.limit(0), 3, budget=0).count() == 0 and fps(df, 0, budget=0).count() == 0


def test_bad_features_are_refused(spark):
    for bad in ([[0.0, 1.0], [float("nan"), 1.0]], [[0.0, 1.0], [1.0]], [[0.0, float("inf")]]):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(bad)], "pos long, features array<double>")
        for budget in (0, 1 << 20):
            with pytest.raises(ValueError):
                fps(df, 1, budget=budget)
    with pytest.raises(ValueError):
        fps(frame(spark, [[0.0, 1.0]]), 1, frame(spark, [[1.0]]))


def test_pools(spark):
    from farspread.functions.config import Selection, Stream
    from farspread.streaming.pool import pooled, pooled_fps, select_streamed

    x = np.random.default_rng(2).normal(size=(60, 3))
    df = frame(spark, x)
    exact = order(fps(df, 5))
    assert order(pooled_fps(df, 5, Stream(batch_size=0))) == exact == order(pooled_fps(df, 5, Stream(batch_size=60)))
    by = {kind: pooled(df, 5, Stream(batch_size=25, pool_alpha=3, pool_stage=kind)) for kind in ("fps", "random")}
    for pool, log in by.values():
        assert [b for _, _, b in log] == [0] * 5 + [1] * 5 + [2] * 5 and len(pool.pos) == 15
    random = [p for p, _, _ in by["random"][1]]
    assert random != [p for p, _, _ in by["fps"][1]] and all(random[i : i + 5] == sorted(random[i : i + 5]) for i in (0, 5, 10))
    small, _ = pooled(df, 5, Stream(batch_size=25, pool_alpha=3, pool_cap=6))
    assert len(small.pos) == 6 and small.evictions == 2
    few = order(pooled_fps(df, 15, Stream(batch_size=25, pool_alpha=1), min_dist2=4.0))
    assert 0 < len(few) < 15 and all(s is None or s >= 4 for _, s in few)
    for method in ("kmeans", "fps"):
        got = select_streamed(df, Selection(5, method=method, n_init=2), Stream(batch_size=25, pool_alpha=3)).collect()
        assert sorted(r["rank"] for r in got) == [0, 1, 2, 3, 4] and {r.pos for r in got} <= {*by["fps"][0].pos.tolist()}


def test_k_means_against_numpy(spark):
    from farspread.operators.clusters import lloyd

    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.7, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    starts = [x[rng.permutation(120)[:3]] for _ in range(4)]

    def by_hand(c):
        for _ in range(300):
            k = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[k == i].mean(0) if (k == i).any() else c[i] for i in range(3)])
            if ((new - c) ** 2).sum(1).max() <= 1e-12:
                break
            c = new
        return new, ((x[:, None] - new[None]) ** 2).sum(2).min(1).sum()

    want = min((by_hand(s) for s in starts), key=lambda r: r[1])
    for how in ({}, {"budget": 0}):
        centres, assigned = lloyd(frame(spark, x).repartition(3), starts, **how)
        assert np.allclose(centres, want[0]) and abs(sum(r.center_d2 for r in assigned.collect()) - want[1]) < 1e-6


def test_distance_to_itself_is_zero():
    from farspread.operators.fps import least_squared_distances

    rng = np.random.default_rng(11)
    for d in (3, 5, 17):
        x = rng.normal(100, 1, size=(600, d))
        assert (least_squared_distances(x, x[::2])[::2] == 0).all()
        want = ((x[:, None] - x[None, ::2]) ** 2).sum(2).min(1)
        assert np.allclose(least_squared_distances(x, x[::2]), want, rtol=1e-9, atol=1e-12)
    assert np.isinf(least_squared_distances(x, None)).all()


def test_diagnostics(spark):
    from farspread.operators import diagnostics, nearest

    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5))
    df = frame(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(40, 1)]
    r = nearest.distance_stats(df.repartition(3)).first()
    assert r.n_pairs == 780 and np.allclose((r["mean"], r["std"], r["min"], r["max"], r.rel_spread), (d.mean(), d.std(), d.min(), d.max(), d.std() / d.mean()))
    assert nearest.distance_stats(df.limit(0)).first().n_pairs == 0
    assert np.allclose(nearest.column_means(df), x.mean(0)) and np.allclose(diagnostics.covariance(df.repartition(3)), np.cov(x.T, bias=True))
    projected, ratio = diagnostics.pca(df, 2)
    centred = x - x.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    got = np.array([row.coords for row in projected.orderBy("pos").collect()])
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :2])) and np.allclose(ratio, s**2 / (s**2).sum())
    f = diagnostics.faithfulness(x, x)
    assert f["n_points"] == 40 and abs(f["spearman"] - 1) < 1e-12 and f["trustworthiness"] == 1
    trust = diagnostics.faithfulness(x, x[:, :2])["trustworthiness"]
    flat = spark.createDataFrame([(i, v.tolist(), v[:2].tolist()) for i, v in enumerate(x)], "pos long, features array<double>, coords array<double>")
    assert abs(diagnostics.trustworthiness(flat.repartition(3), 12).first().trust - trust) < 1e-12 and trust < 1
    mds, _ = diagnostics.classical_mds(x, 5)
    assert np.allclose(np.sort(np.sqrt(((mds[:, None] - mds[None]) ** 2).sum(2)), None), np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), None), atol=1e-6)
    stress = lambda y: ((np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)) - np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))) ** 2).sum()
    assert stress(diagnostics.smacof(x, 2)) <= stress(mds[:, :2])
    two = np.vstack([rng.normal(0, 0.1, (15, 4)), rng.normal(6, 0.1, (15, 4))])
    y = diagnostics.tsne(two)
    near = np.argsort(((y[:, None] - y[None]) ** 2).sum(2), axis=1)[:, 1:4]
    assert ((near < 15) == (np.arange(30) < 15)[:, None]).all()
    panels = diagnostics.figure_data(df, order_of(spark, df)).groupBy("panel", "series").count().collect()
    assert {(p.panel, p.series): p["count"] for p in panels} == {("distances", "count"): 60, ("scree", "share"): 5, ("scree", "running"): 5, ("coverage", "chosen"): 5, ("cdf", "chosen"): 35, ("cdf", "random"): 35}


def order_of(spark, df):
    return fps(df, 6).select("pos", "rank")


def test_ranks_take_no_single_task(spark):
    from farspread.operators import diagnostics

    rng = np.random.default_rng(9)
    data = [(int(a), float(b)) for a, b in zip(rng.integers(0, 20, 200), rng.normal(size=200).round(1))]
    df = spark.createDataFrame([*data, (None, 1.0)], "a long, b double").repartition(5)

    def ranks(v):
        return np.array([sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v])

    want = np.corrcoef(ranks([a for a, _ in data]), ranks([b for _, b in data]))[0, 1]
    assert abs(diagnostics.spearman(df, "a", "b").first().rho - want) < 1e-12
    got = {r.value: r.share for r in diagnostics.cumulative(df, "a").collect()}
    assert all(abs(got[v] - sum(a <= v for a, _ in data) / 200) < 1e-12 for v in got) and len(got) == len({a for a, _ in data})


def test_reasons_of_short_selections():
    from farspread.operators.select import shortfall

    assert shortfall(5, 5, 9) is None and shortfall(3, 5, 3, min_dist2=1.0) == "exhausted" and shortfall(3, 5, 9, min_dist2=1.0) == "min_dist_stop"
    assert shortfall(3, 5, 9, fill="none", method="kmeans") == "strict_no_fill" and shortfall(3, 5, 9) == "exhausted"


def test_strategies_agree(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "pos long, features array<double>")
    one = [r.pos for r in fps(df, 6).orderBy("rank").collect()]
    assert one == greedy(x, 6).indices.tolist()
    assert one == [r.pos for r in fps(df.repartition(5), 6, budget=0).orderBy("rank").collect()]


def test_quotas_add_up():
    assert sum(quota(b, 7, 40) for b in range(7)) == 40
    assert min(quota(b, 7, 3) for b in range(7)) == 1


def test_identity_and_settings():
    assert identity.descriptor_id({"a": 1.0, "b": [2]}) == identity.descriptor_id({"b": (2,), "a": 1.0 + 1e-13})
    assert len(identity.descriptor_id({})) == 16
    assert species.parse_species(["O", 1]) == (1, 8) and species.parse_species(["auto"]) is None
    assert species.descriptor_width(6, 9, 3) == 5940
    with pytest.raises(ValueError):
        config.Sampling(shuffle=True, scan=False)
    with pytest.raises(ValueError):
        config.Selection(1, fps_init="nowhere")


def test_cells():
    p, c, pbc, mode = box.build_cell([[0, 0, 0], [1, 0, 0]], np.zeros((3, 3)), [False] * 3, config.Box(vacuum=5))
    assert mode == "boxed" and pbc.all() and np.allclose(sorted(np.linalg.norm(c, axis=1)), [10, 10, 11])
    assert np.allclose((p.min(0) + p.max(0)) / 2, np.abs(c).sum(0) / 2)
    assert box.build_cell([[0, 0, 0]], np.eye(3), [True] * 3, config.Box())[3] == "native"
    assert box.build_cell([[0, 0, 0]], np.eye(3), [True, True, False], config.Box())[3] == "padded"


def test_xyz_source(spark, tmp_path):
    f = tmp_path / "a.extxyz"
    f.write_text('2\nLattice="1 0 0 0 1 0 0 0 1" pbc="T T F" tag=x\nC 0 0 0\nH 1 0 0\n\n1\n\nfe 0 0 1\n')
    spark.dataSource.register(xyz.ExtXyzSource)
    rows = spark.read.format("extxyz").option("paths", str(f)).option("framesPerTask", 1).load().orderBy("frame_index").collect()
    assert [r.numbers for r in rows] == [[6, 1], [26]] and rows[0].pbc == [True, True, False] and rows[0].info == {"tag": "x"}
    bad = tmp_path / "b.xyz"
    bad.write_text("3\n\nC 0 0 0\n")
    with pytest.raises(ScanError):
        xyz.scan(str(bad))


def test_micro_batches(spark, tmp_path):
    from farspread.streaming.pool import Pool, stream_fps

    x = np.random.default_rng(11).normal(size=(60, 3))
    for i in range(3):
        frame(spark, x[20 * i : 20 * i + 20], 20 * i).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("pos long, features array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pool = stream_fps(source, 4, 5, str(tmp_path / "state"), cap=12)
    batches = len(list((tmp_path / "state" / "offsets").glob("[0-9]*")))
    assert batches > 1 and len(pool.pos) == min(12, 5 * batches) and len({*pool.pos.tolist()}) == len(pool.pos) and pool.evictions == max(0, batches - 2)
    assert np.allclose(pool.features, x[pool.pos]) and len(pool.final(4).indices) == 4
    # a batch gives what its rows give together, however they are dealt
    one = Pool(40)
    one.add(np.arange(20), x[:20], 5)
    assert one.pos.tolist() == greedy(x[:20], 5).indices.tolist()
