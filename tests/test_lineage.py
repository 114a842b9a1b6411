"""Merge log, counter-based draws, k-means starts, commits of a batch."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import tiltframe.streaming.online as online
from conftest import SF_SMALL
from tiltframe.functions.uniform import gaussian, gaussian_sql, uniform, uniform_col, uniform_sql
from tiltframe.operators import lineage as lin
from tiltframe.operators import macro as mac
from tiltframe.operators.kmeans import kmeans_cost, kmeans_parallel, lloyd, weighted_seeds
from tiltframe.operators.maintain import OutlierRule, merge_rows, replace_stale, update_state
from tiltframe.params import STATE_SCHEMA, OnlineParams, SnapshotParams
from tiltframe.plans.common import ev_points
from tiltframe.session import new_run_dir
from tiltframe.streaming.online import Milestones, OnlineClusterer

LOG = "id long, into long, after long, seq long, tick long"


class Lists:
    """The plain model: whole lists, merges by concatenation."""

    def __init__(self, r, ids):
        self.r, self.of, self.log, self.next = r, {i: [i] for i in ids}, [], max(ids) + 1

    def merge(self, tick):
        a, b = self.r.choice(sorted(self.of), 2, replace=False)
        self.log.append((int(self.of[b][0]), int(self.of[a][0]), int(self.of[a][-1]), len(self.log), tick))
        self.of[a] = self.of[a] + self.of.pop(b)

    def born(self):
        self.of[self.next] = [self.next]
        self.next += 1


def _history(seed, ticks=12):
    m = Lists(np.random.default_rng(seed), range(8))
    states = {0: {k: list(v) for k, v in m.of.items()}}
    for t in range(1, ticks):
        for _ in range(int(m.r.integers(0, 5))):
            if m.r.random() < 0.6 and len(m.of) > 2:
                m.merge(t)
            elif m.r.random() < 0.3:
                m.of.pop(int(m.r.choice(sorted(m.of))))  # its slot is taken
                m.born()
            else:
                m.born()
        states[t] = {k: list(v) for k, v in m.of.items()}
    return m.log, states


def _state(spark, lists):
    rows = [(i, [v[0]] if len(v) == 1 else [v[0], v[-1]]) for i, v in enumerate(lists[k] for k in sorted(lists))]
    return spark.createDataFrame([(int(s), [int(x) for x in ids]) for s, ids in rows], "slot int, ids array<bigint>")


@pytest.mark.parametrize("seed", [0])
def test_lists_and_relations_from_the_log(spark, seed):
    log, states = _history(seed)
    table = spark.createDataFrame(log, LOG).repartition(3)
    for t in (0, 11):
        want = {(i, p, int(x)) for i, k in enumerate(sorted(states[t])) for p, x in enumerate(states[t][k])}
        got = lin.members(_state(spark, states[t]), table.where(F.col("tick") <= t))
        assert {tuple(r) for r in got.collect()} == want
        whole = lin.with_members(_state(spark, states[t]), table.where(F.col("tick") <= t)).orderBy("slot").collect()
        assert [list(r["ids"]) for r in whole] == [[int(x) for x in states[t][k]] for k in sorted(states[t])]
    for t2, t1 in ((0, 11), (5, 9)):
        want = {(i, j) for i, a in enumerate(sorted(states[t1])) for j, b in enumerate(sorted(states[t2])) if set(states[t1][a]) & set(states[t2][b])}
        old = _state(spark, states[t2]).withColumn("at", F.lit(t1).cast("long")).withColumn("from", F.lit(t2).cast("long"))
        for since in (None, "from"):
            assert {tuple(r) for r in lin.related(_state(spark, states[t1]), old, table, "at", since).collect()} == want


def test_a_long_chain_takes_few_tables(spark):
    n = 1000
    log = spark.createDataFrame([(i, i + 1, i + 1, i, i) for i in range(n)], LOG)
    tables = lin.jumps(log)
    assert len(tables) == 10
    asked = spark.createDataFrame([(0, 10), (0, n), (500, 3), (n, 5), (-1, 5)], "id long, at long")
    assert sorted((r["id"], r["at"], r["root"]) for r in lin.roots_at(asked, tables, "at").collect()) == [(-1, 5, -1), (0, 10, 11), (0, n, n), (500, 3, 500), (n, 5, n)]
    assert lin.jumps(lin.empty_log(spark)) == []


def test_state_rows_keep_their_size(spark):
    """100,000 merges: two ids a row, one log row a merge, every id found."""
    r = np.random.default_rng(5)
    q = 12
    c = r.random((q, 2))
    st = {"ids": [[i] for i in range(q)], "n": np.ones(q, dtype=np.int64), "cf1x": c.copy(), "cf2x": c * c, "cf1t": np.zeros(q, dtype=np.int64),
          "cf2t": np.zeros(q, dtype=np.int64), "centroid": c.copy(), "rmsd": np.zeros(q), "stale": np.zeros(q, dtype=bool)}
    rule = OutlierRule(st, 0.0, False, q)
    for x in r.random((100_000, 2)):
        rule.add(x, 1)
    assert len(rule.merged) == 100_000 and max(map(len, st["ids"])) <= 2 and st["n"].sum() == q + 100_000
    cols = list(zip(*rule.merged))
    log = spark.createDataFrame([(a, b, c_, i, 1) for i, (a, b, c_) in enumerate(zip(*cols))], LOG)
    state = spark.createDataFrame([(i, [int(v) for v in ids]) for i, ids in enumerate(st["ids"])], "slot int, ids array<bigint>")
    got = lin.members(state, log).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"), F.max_by("id", "pos").alias("end")).collect()
    assert sum(g["n"] for g in got) == q + 100_000  # every micro-cluster there ever was, once
    for g in got:
        assert g["n"] == st["n"][g["slot"]] and g["last"] == g["n"] - 1 and g["end"] == st["ids"][g["slot"]][-1]


def test_ids_are_never_given_twice(spark):
    st = spark.createDataFrame(
        [(i, [i], 5, [float(i)], [float(i * i)], 50, 500, [float(i)], 0.1) for i in range(4)], STATE_SCHEMA)
    p = OnlineParams(q=4, dim=1, t_factor=0.1, recursive_outliers=False)
    seen = set(range(4))
    for b in range(3):
        out = spark.createDataFrame([(10, i, [1000.0 * b + 50.0 * i]) for i in range(7)], "seq_tick long, seq_id long, x array<double>")
        path = new_run_dir(spark, "ids")
        update_state(st, None, out, p, 10).write.parquet(path)
        step = spark.read.parquet(path)
        st = step.where("kind = 'state'").select(*STATE_SCHEMA.fieldNames(), "next_id")
        fresh = {r["id"] for r in merge_rows(step).collect()} | {i for r in st.collect() for i in r["ids"]}
        assert st.first()["next_id"] == 4 + 7 * (b + 1) and st.agg(F.sum("n")).first()[0] == 20 + 7 * (b + 1)
        seen |= fresh
    assert seen <= set(range(25))


# -- draws ------------------------------------------------------------------------


def test_draws_are_the_same_everywhere(spark):
    idx = [0, 1, 2, 77, 2**31, 2**32 + 5, 123456789012345]
    want = uniform(42, 3, np.array(idx))
    df = spark.createDataFrame([(i,) for i in idx], "i long")
    assert [r[0] for r in df.select(uniform_col(42, 3, "i")).collect()] == want.tolist()
    con = duckdb.connect()
    rel = con.sql(f"SELECT {uniform_sql(42, 3, 'i')}, {gaussian_sql(42, 3, 'i')} FROM (SELECT unnest({idx}) AS i)").fetchall()
    assert [r[0] for r in rel] == want.tolist()
    assert [r[1] for r in rel] == pytest.approx(gaussian(42, 3, np.array(idx)).tolist(), abs=1e-12)


def test_draws_look_uniform_and_independent():
    i = np.arange(200_000)
    for seed, stream in ((0, 0), (1, 0), (0, 1), (42, 7)):
        u = uniform(seed, stream, i)
        counts = np.histogram(u, 50, (0, 1))[0]
        assert ((counts - 4000) ** 2 / 4000).sum() < 100  # 49 degrees of freedom
        assert abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.01
        assert abs(np.corrcoef(u, uniform(seed, stream + 1, i))[0, 1]) < 0.01
        assert abs(np.corrcoef(u, uniform(seed + 1, stream, i))[0, 1]) < 0.01
        assert 0 < u.min() and u.max() < 1
    g = gaussian(3, 0, i)
    assert abs(g.mean()) < 0.01 and abs(g.std() - 1) < 0.01


def test_weighted_draws_follow_the_weights(spark):
    rows = [(t, i, [float(i)], w, w / 10) for t in (1, 2) for i, w in enumerate([1, 2, 3, 4])]
    cw = spark.createDataFrame(rows, "tc long, slot int, center array<double>, n long, weight double")
    got = {}
    for r in mac.weighted_sample(cw, 100_000, seed=3, key=["tc"]).collect():
        got.setdefault(r["tc"], {})[r["slot"]] = r["draws"]
    for t in (1, 2):
        assert sum(got[t].values()) == 100_000
        assert sum((got[t][i] - 10_000 * w) ** 2 / (10_000 * w) for i, w in enumerate([1, 2, 3, 4])) < 16  # 3 degrees of freedom
    assert got[1] != got[2]


# -- k-means ----------------------------------------------------------------------------


def _blobs(spark, n=600, k=6, seed=4):
    r = np.random.default_rng(seed)
    c = r.random((k, 3)) * 100
    x = c[r.integers(0, k, n)] + r.standard_normal((n, 3))
    return c, x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def test_start_and_rounds(spark):
    c, x, df = _blobs(spark)
    start = [tuple(r) for r in kmeans_parallel(df.repartition(5), 6, 9).orderBy("slot").collect()]
    assert start == [tuple(r) for r in kmeans_parallel(df.repartition(2), 6, 9).orderBy("slot").collect()]
    assert {tuple(v) for _, v in start} <= {tuple(v) for v in x.tolist()}
    found = lloyd(df, kmeans_parallel(df, 6, 9), 20, 1e-4)
    centers = np.array([r["center"] for r in found.orderBy("slot").collect()])
    assert np.abs(centers[:, None] - c[None]).sum(axis=2).min(axis=0).max() < 1.5  # every blob has its center
    # plain Lloyd from the same start
    cur = np.array([v for _, v in start])
    for _ in range(20):
        own = ((x[:, None] - cur[None]) ** 2).sum(axis=2).argmin(axis=1)
        cur = np.array([x[own == j].mean(axis=0) if (own == j).any() else cur[j] for j in range(6)])
    assert centers == pytest.approx(cur, abs=1e-6)
    cost = kmeans_cost(df, found).first()["wssse"]
    assert cost == pytest.approx(((x[:, None] - cur[None]) ** 2).sum(axis=2).min(axis=1).sum())


def test_start_of_few_and_equal_points(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)] + [(30, [5.0, 5.0])], "id long, x array<double>")
    got = kmeans_parallel(same, 5, 1).collect()
    assert {tuple(r["center"]) for r in got} == {(1.0, 2.0), (5.0, 5.0)} and len(got) == 2
    assert kmeans_parallel(same.limit(0), 5, 1).count() == 0
    assert weighted_seeds(np.zeros((3, 2)), np.zeros(3), 2, 1) == []


def test_start_over_tasks_without_rows(spark):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(6)]
    sparse = spark.createDataFrame(spark.sparkContext.parallelize(rows, 20), "id long, x array<double>")
    one = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "id long, x array<double>")
    got = kmeans_parallel(sparse, 3, 9).orderBy("slot").collect()
    assert got and got == kmeans_parallel(one, 3, 9).orderBy("slot").collect()


def test_rounds_read_the_points_once(spark, monkeypatch):
    import tiltframe.operators.assign as a

    _, x, df = _blobs(spark, 500)
    reads = spark.sparkContext.accumulator(0)
    counted = df.rdd.map(lambda r: (reads.add(1), r)[1]).toDF(df.schema)
    start = df.orderBy("id").limit(6).select(F.col("id").cast("int").alias("slot"), F.col("x").alias("center"))
    monkeypatch.setattr(a, "PACKED_BYTES", 100)  # four points a row, the last rows fewer
    folder = new_run_dir(spark, "rounds")
    got = {r["slot"]: r["center"] for r in lloyd(counted.repartition(3), start, 5, 0.0, folder=folder).collect()}
    assert reads.value == 500
    assert 125 <= spark.read.parquet(f"{folder}/points").count() <= 128
    cur = x[:6].copy()
    for _ in range(5):
        own = ((x[:, None] - cur[None]) ** 2).sum(axis=2).argmin(axis=1)
        cur = np.array([x[own == j].mean(axis=0) if (own == j).any() else cur[j] for j in range(6)])
    assert np.array([got[j] for j in range(6)]) == pytest.approx(cur, abs=1e-9)


def test_rounds_go_on_after_a_failure(spark, monkeypatch):
    import tiltframe.operators.kmeans as km

    _, _, df = _blobs(spark, 300)
    start = df.orderBy("id").limit(6).select(F.col("id").cast("int").alias("slot"), F.col("x").alias("center"))
    whole = [tuple(r) for r in lloyd(df, start, 6, 0.0).orderBy("slot").collect()]
    folder, calls, plain = new_run_dir(spark, "rounds"), [], km.assign_and_summarize

    def failing(*a, **k):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return plain(*a, **k)

    monkeypatch.setattr(km, "assign_and_summarize", failing)
    with pytest.raises(RuntimeError):
        lloyd(df, start, 6, 0.0, folder=folder)
    before = len(calls)
    assert [tuple(r) for r in lloyd(df, start, 6, 0.0, folder=folder).orderBy("slot").collect()] == whole
    assert len(calls) - before <= 4  # the first two rounds are not done again


# -- commits --------------------------------------------------------------------------------


P = OnlineParams(q=6, dim=2, min_init_points=100, m=20, delta=5)


def _facts(m):
    st = sorted((r["slot"], tuple(r["ids"]), r["n"], r["cf1t"], r["cf2t"]) for r in m.state().collect())
    return st, m.time, m.total, sorted(map(tuple, m.merges().collect())), sorted(map(tuple, m.progress_table().collect()))


@pytest.mark.parametrize("at", ["state", "sink", "manifest"])
def test_each_milestone_is_there_once_whatever_fails(spark, monkeypatch, tmp_path, at):
    pts = ev_points(spark, SF_SMALL).where("tick < 7")
    total = pts.count()
    ms = lambda sink: Milestones([total * 2 // 3], band=20, horizon=4, k=2, sink=sink)
    ref = OnlineClusterer(spark, P, snapshot=SnapshotParams(2, 1), milestones=ms(str(tmp_path / "ref")))
    for t in range(7):
        ref.step(pts.where(F.col("tick") == t), t)
    reached = [r["tick"] for r in ref.milestone_centers().select("tick").distinct().collect()]
    assert reached
    base, sink = new_run_dir(spark, "commit"), str(tmp_path / "sink")
    name = {"state": "update_state", "sink": "append_centers", "manifest": "_write_text"}[at]
    plain, armed = getattr(online, name), [True]
    m = OnlineClusterer(spark, P, base_dir=base, snapshot=SnapshotParams(2, 1), milestones=ms(sink))

    def failing(*a, **k):
        if armed[0] and m.time + 1 == reached[0] and m.initialized:
            armed[0] = False
            if at == "sink":
                plain(*a, **k)  # written, then lost
            raise RuntimeError("lost")
        return plain(*a, **k)

    monkeypatch.setattr(online, name, failing)
    for t in range(7):
        try:
            m.step(pts.where(F.col("tick") == t), t)
        except RuntimeError:
            m = OnlineClusterer(spark, P, base_dir=base, snapshot=SnapshotParams(2, 1), milestones=ms(sink))
            assert m.time <= t
            m.step(pts.where(F.col("tick") == t), t)
        m.step(pts.where(F.col("tick") == t), t)  # a replay of a committed batch
    assert not armed[0]
    assert _facts(m) == _facts(ref)
    key = lambda d: sorted((r["mark"], r["tick"], r["cluster"], round(r["weight"], 6)) for r in d.collect())
    assert key(m.milestone_centers()) == key(ref.milestone_centers())
    assert sorted(r["value"] for r in spark.read.text(sink).collect()) == sorted(r["value"] for r in spark.read.text(str(tmp_path / "ref")).collect())


def test_given_seeds_and_broken_rows(spark):
    seeds = spark.createDataFrame([(0, [0.0, 0.0]), (1, [50.0, 50.0])], "slot int, center array<double>")
    m = OnlineClusterer(spark, OnlineParams(q=2, dim=2), seeds=seeds)
    rows = [(1, [1.0, 1.0]), (2, [49.0, 50.0]), (3, None), (4, [1.0]), (5, [0.0, 2.0])]
    for t in (0, 1):
        m.step(spark.createDataFrame(rows, "id long, x array<double>"), t)
    assert (m.total, m.state().agg(F.sum("n")).first()[0], m.rejects().count()) == (6, 6, 4)
    m.step(spark.createDataFrame([(9, None)], "id long, x array<double>"), 2)  # broken rows alone
    m.step(spark.createDataFrame([], "id long, x array<double>"), 3)
    assert (m.total, m.time, m.version, m.rejects().count()) == (6, 4, 2, 5)
    again = OnlineClusterer(spark, OnlineParams(q=2, dim=2), base_dir=m.base)
    assert (again.total, again.version) == (6, 2)


def test_leftovers_of_one_arrival_key(spark):
    st = spark.createDataFrame([(0, [0], 0, [0.0], [0.0], 0, 0, [0.0], 0.0, True), (1, [1], 2, [9.0], [45.0], 0, 0, [4.5], 1.0, False)], "slot int, ids array<bigint>, n bigint, cf1x array<double>, cf2x array<double>, cf1t bigint, cf2t bigint, centroid array<double>, rmsd double, stale boolean")
    out = spark.createDataFrame([(5, 1, [7.0]), (5, 1, [8.0]), (6, 1, [9.0])], "seq_tick long, seq_id long, x array<double>")
    got, rest = replace_stale(st, out)
    assert [r["cf1x"] for r in got.orderBy("slot").collect()] == [[7.0], [9.0]]
    assert sorted(r["x"][0] for r in rest.collect()) == [8.0, 9.0] and rest.columns == out.columns
