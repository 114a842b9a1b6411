"""Vector searches against brute force."""

import numpy as np
import pytest

import tiltframe.llm.ann as ann
import tiltframe.llm.cover_tree as ct

SCHEMA = "id long, vec_id long, embedding array<double>, score int"


def _rows(n, d, seed, copies=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(10_000 + i, x[0].tolist()) for i in range(copies)]
    odd = [(20_000, None), (20_050, [None, *[1.0] * (d - 1)]), (20_100, [float("nan")] * d), (20_150, [float("inf")] * d), (20_200, [0.0] * d), (None, [1.0] * d), (20_250, [1.0]), (20_300, [])]
    return rows + odd + rows[:3]


def _frame(spark, rows):
    return spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], SCHEMA)


def _brute(rows, step, k, score, ok):
    items = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and ok(v):
            items[i] = v
    out = []
    for q, v in items.items():
        if q % step == 0:
            hits = sorted((-score(v, w), i) for i, w in items.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])]
    return sorted(out)


def _int_score(a, b):
    return sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b))


@pytest.mark.parametrize("n,d,block", [(600, 8, 2048), (600, 8, 100), (3, 4, 2048)])
def test_exact(spark, monkeypatch, n, d, block):
    monkeypatch.setattr(ct, "BLOCK_ROWS", block)
    monkeypatch.setattr(ct, "BATCH_QUERIES", max(4, block // 16))
    monkeypatch.setattr(ct, "LEAF", 8)
    rows = _rows(n, d, 1, copies=60)
    got = sorted(tuple(r) for r in ct.top_k(spark, _frame(spark, rows), lambda i: i % 50 == 0, 5).collect())
    assert got == _brute(rows, 50, 5, _int_score, lambda v: True)


def test_exact_on_large_components(spark, monkeypatch):
    """Scores past 2^53, up to near 2^63, and rows whose squares leave a double."""
    monkeypatch.setattr(ct, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ct, "LEAF", 8)
    rows = [(i, v) for i, v in _rows(200, 4, 5, copies=5) if v is None or len(v) == 4]
    r = np.random.default_rng(11)
    rows += [(30_000 + i, (v * 3e6).tolist()) for i, v in enumerate(r.standard_normal((60, 4)))]
    rows += [(40_000 + i, [20_000.0 + i, 0.25, 1e6, 1.0]) for i in range(12)]  # ties and near ties past 2^53
    # far below all others for the queries asked, which have positive components
    rows += [(50_001, [-1e300, 0.0, 0.0, 0.0]), (60_000, [5.0, 1.0, 2.0, 3.0]), (60_050, [9e6, 1.0, 2.0, 4e6])]
    asked = [40_000, 60_000, 60_050]
    got = sorted(tuple(t) for t in ct.top_k(spark, _frame(spark, rows), lambda i: i.isin(asked), 5).collect())
    assert got == [t for t in _brute(rows, 10, 5, _int_score, lambda v: True) if t[0] in asked]


def test_exact_refuses_scores_beyond_a_long(spark):
    rows = [(i, [1e8 * (1 + i), 1.0]) for i in range(4)]
    with pytest.raises(Exception, match="does not fit a long"):
        ct.top_k(spark, _frame(spark, rows), lambda i: i == 0, 2).collect()


@pytest.mark.parametrize("size", [1e4, 1e6])
def test_negative_ties_are_not_pruned(monkeypatch, size):
    monkeypatch.setattr(ct, "LEAF", 1)
    q = np.array([[size, 0.0]])
    x = np.column_stack((np.full(40, -size), np.arange(40.0)))  # one score, smallest ids last
    best = ct.dual_search(q, x, np.arange(40)[::-1].copy(), 3, np.array([-np.inf]))
    assert best.low[0].tolist() == [0, 1, 2] and (best.score[0] == -size * size).all()
    # the threshold of a first round: ties with it count, and so does one better by 1
    best = ct.dual_search(q, x[:1], np.array([7]), 1, np.array([-size * size]))
    assert best.row[0].tolist() == [0]
    best = ct.dual_search(np.array([[1.0, size]]), np.array([[-1.0, -size]]), np.array([7]), 1, np.array([-size * size - 2]))
    assert best.row[0].tolist() == [0]


def test_exact_without_rows(spark):
    assert ct.top_k(spark, _frame(spark, []), lambda i: i % 50 == 0, 5).count() == 0


def test_tree_covers(monkeypatch):
    x = np.random.default_rng(2).standard_normal((500, 5))

    def check(node):
        assert np.sqrt(((x[node.rows] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.kids:
            assert sorted(np.concatenate([k.rows for k in node.kids]).tolist()) == sorted(node.rows.tolist())
            for k in node.kids:
                check(k)

    monkeypatch.setattr(ct, "LEAF", 16)
    check(ct.cover_tree(x))


def _dot(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


def test_forest_is_exact_on_few_vectors(spark):
    rows = _rows(300, 6, 3, copies=40)
    got = sorted(tuple(r) for r in ann.nearest(spark, _frame(spark, rows), lambda i: i % 20 == 0, 20).collect())
    assert got == _brute(rows, 20, 20, _dot, lambda v: any(v))


@pytest.mark.parametrize("scale", [False, True])
def test_forest_recall(spark, scale):
    r = np.random.default_rng(4)
    x = r.standard_normal((4000, 24)) * (r.uniform(0.5, 1.5, (4000, 1)) if scale else 1.0)
    df = spark.createDataFrame([(0, i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    out = ann.nearest(spark, df, lambda i: i % 20 == 0, 20, candidates=500).collect()
    hit = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        worst = np.sort(s)[-20]
        mine = [t for t in out if t.query_id == q]
        assert sorted(t["rank"] for t in mine) == list(range(1, 21))
        hit += sum(t.score >= worst - 1e-9 for t in mine)
    assert hit / (200 * 20) >= 0.9


def test_forest_splits_crowded_prefixes(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)
    r = np.random.default_rng(6)
    near = np.ones(8) + 1e-9 * r.standard_normal((900, 8))  # one string in every tree
    x = np.concatenate((near, r.standard_normal((900, 8))))
    df = spark.createDataFrame([(0, i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    out = ann.nearest(spark, df, lambda i: i % 100 == 0, 5, trees=8, share=0.2, candidates=100).collect()
    assert len(out) == 18 * 5


def _recall(spark, items, step, k, **kw):
    """Share of the true ``k`` nearest found; every query must get ``k`` rows."""
    df = spark.createDataFrame([(0, i, v.tolist(), 0) for i, v in items], SCHEMA)
    out = {}
    for t in ann.nearest(spark, df, lambda i: i % step == 0, k, **kw).collect():
        out.setdefault(t.query_id, []).append(t)
    hit = asked = 0
    for q, v in items:
        if q % step == 0:
            s = np.sort([w @ v for i, w in items if i != q and len(w) == len(v)])
            assert sorted(t["rank"] for t in out[q]) == list(range(1, k + 1))
            hit += sum(t.score >= s[-k] - 1e-9 for t in out[q])
            asked += k
    return hit / asked


@pytest.mark.parametrize("n", [500, 2000, 10_000])
def test_forest_recall_with_production_parameters(spark, n):
    """Unstructured unit vectors, the hardest case: no setting is lowered."""
    x = np.random.default_rng(n).standard_normal((n, 64))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    df = spark.createDataFrame([(0, i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    out = {}
    for t in ann.nearest(spark, df, lambda i: i % 20 == 0, 20).collect():
        out.setdefault(t.query_id, []).append(t.vec_id)
    hit = 0
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(out[q]) == 20
        hit += len(set(out[q]) & set(np.argpartition(s, -20)[-20:].tolist()))
    print(f"recall of {n}: {hit / n:.4f}")
    assert hit / n >= 0.9


def test_forest_queries_in_batches(spark, monkeypatch):
    """Blocks visited by many batches of queries give what one batch gives."""
    x = np.random.default_rng(12).standard_normal((400, 8))
    df = spark.createDataFrame([(0, i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    search = lambda: sorted(tuple(r) for r in ann.nearest(spark, df, lambda i: i % 2 == 0, 5, trees=8, candidates=200).collect())
    whole = search()
    monkeypatch.setattr(ann, "BATCH_QUERIES", 7)
    assert search() == whole and len(whole) == 200 * 5


def test_forest_with_one_long_vector(spark):
    x = np.random.default_rng(8).standard_normal((3000, 16))
    x[1] *= 100
    assert _recall(spark, list(enumerate(x)), 20, 20, candidates=500) >= 0.9


def test_forest_of_two_vector_lengths(spark):
    r = np.random.default_rng(9)
    items = list(enumerate(r.standard_normal((3000, 16)))) + [(5000 + i, v) for i, v in enumerate(r.standard_normal((300, 7)))]
    assert _recall(spark, items, 20, 20, candidates=400) >= 0.9


def test_forest_ascends_to_the_root(spark, monkeypatch):
    """Queries whose prefix has no block still get their candidates."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)
    r = np.random.default_rng(10)
    near = np.ones(8) + 0.01 * r.standard_normal((1000, 8))
    x = np.concatenate((near, -np.ones(8) + 0.01 * r.standard_normal((20, 8))))
    assert _recall(spark, list(enumerate(x)), 10, 5, trees=2, share=0.0, candidates=100) >= 0.3


def test_forest_keeps_the_smallest_ids_of_a_tie():
    import pyarrow as pa

    n = 60
    index = pa.table({"h": pa.array([0] * n, pa.int64()), "uid": list(range(n)), "low": list(range(n, 0, -1)), "v": [[1.0, float(i)] for i in range(n)]})
    asked = pa.table({"h": pa.array([0], pa.int64()), "uid": [0], "level": pa.array([0], pa.int32()), "v": [[1.0, 0.0]]})
    got = ann._score_fn(3)(index, asked)
    assert {n - 1, n - 2, n - 3} <= set(got["p"].to_pylist())


def test_prefix_range():
    q = np.array([0b1011 << 60, 5], dtype=np.uint64)
    for bits in (0, 1, 3, 64):
        low, high = ann.prefix_range(q, bits)
        for x, lo, hi in zip(q.tolist(), low.tolist(), high.tolist()):
            assert lo == (x >> (64 - bits) << (64 - bits)) and hi - lo == 2 ** (64 - bits) - 1


def test_forest_without_rows(spark):
    assert ann.nearest(spark, _frame(spark, []), lambda i: i % 20 == 0, 20).count() == 0
