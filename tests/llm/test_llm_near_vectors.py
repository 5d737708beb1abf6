"""Near vectors against all pairs, and the parts of the hash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellback.llm import groups as G
from tellback.llm import near_vectors as V


def planted(seed=0, width=32, clusters=40, loose=600):
    """Random vectors, groups of near copies of very different sizes, pairs around the threshold, chains, exact and scaled copies."""
    r = np.random.default_rng(seed)
    out = [r.standard_normal((loose, width))]

    def near(x, similar, n):
        y = r.standard_normal((n, width))
        y -= np.outer(y @ x, x) / (x @ x)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        return similar * x / np.linalg.norm(x) + (1 - similar**2) ** 0.5 * y

    for k in range(clusters):
        x = r.standard_normal(width)
        out += [x[None], near(x, r.uniform(0.86, 0.999), int(r.integers(1, 12)))]
    hub = r.standard_normal(width)
    out += [near(hub, 0.98, 300), near(hub, 0.93, 200)]
    step = hub
    for _ in range(20):  # a chain whose ends are far apart
        step = near(step, 0.93, 1)[0]
        out.append(step[None])
    out.append(np.repeat(hub[None], 70, 0))
    out.append(3 * out[1][:1])
    out.append(-out[1][:1])
    return np.concatenate(out)


def brute(rows, similar=0.9):
    """(id, vector) -> (links, smallest id of the group) for each row."""
    fine = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {k: [] for k in range(len(rows))}
    for width in {len(rows[k][1]) for k in fine}:
        at = [k for k in fine if len(rows[k][1]) == width]
        u = np.array([rows[k][1] for k in at], float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        for a, row in zip(at, u @ u.T >= similar):
            near[a] = [at[j] for j in np.flatnonzero(row) if at[j] != a]
    out, seen = {}, {}
    for k in range(len(rows)):
        if k not in seen:
            todo, own = [k], {k}
            while todo:
                for j in near[todo.pop()]:
                    if j not in own:
                        own.add(j)
                        todo.append(j)
            low = min((rows[j][0] for j in own if rows[j][0] is not None), default=None)
            seen |= {j: low for j in own}
        out[k] = (len(near[k]), seen[k])
    return out


def judged(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_links_and_groups(spark):
    x = planted()
    order = np.random.default_rng(3).permutation(len(x))
    rows = [(int(i), [float(c) for c in x[j]]) for i, j in enumerate(order)]
    got = judged(V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)))
    want = brute(rows)
    assert got == sorted(((rows[k][0], *v, rows[k][0] == v[1]) for k, v in want.items()), key=repr)


def test_small_and_large_widths(spark):
    for width in (2, 5, 100):
        x = planted(width, width, 10, 60)
        rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
        got = judged(V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
        assert got == sorted(((rows[k][0], *v, rows[k][0] == v[1]) for k, v in brute(rows).items()), key=repr)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (7, [1.0, 2.0]), (None, [1.0, 2.0])]
    rows += [(9, [1e-30, 2e-30]), (10, [1e30, 2e30]), (11, [1.0, 2.0, 0.0]), (12, [-1.0, -2.0]), (7, [5.0, -1.0]), (None, [0.0, -3.0, 0.0]), (None, [0.0, -3.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"node": F.lit(1), "v": F.lit("x"), "key": F.lit(2), "links": F.lit(3)})
    got = judged(V.near_duplicates(df))
    single = [(r, 0, r, True) for r in (1, 2, 3, 4, 5, 6, 11, 12)] + [(7, 0, 7, True)]
    group = [(7, 5, 7, True)] * 2 + [(r, 5, 7, False) for r in (8, 9, 10, None)] + [(None, 1, None, True)] * 2
    assert got == sorted(single + group, key=repr)
    assert judged(V.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>"))) == []


@pytest.mark.parametrize("width,parts", [(16, 1), (64, 2), (200, 2), (64, 3)])
def test_pairs_at_the_threshold_meet(width, parts):
    r = np.random.default_rng(width + parts)
    a = V.unit(r.standard_normal((1500, width)))
    b = r.standard_normal((1500, width))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + (1 - 0.81) ** 0.5 * V.unit(b)
    met = np.zeros(1500, bool)
    for t in range(V.tables(width, parts, 0.9)):
        met |= (V.buckets(a, t, parts)[:, :, None] == V.buckets(b, t, parts)[:, None, :]).any((1, 2))
    assert met.mean() >= 0.99
    apart = np.bitwise_count((V.sketches(a) ^ V.sketches(b)).view(np.uint64)).sum(1)
    assert apart.max() <= V.most_signs(0.9)
    others = np.bitwise_count((V.sketches(a) ^ V.sketches(a[::-1])).view(np.uint64)).sum(1)
    assert np.mean(others <= V.most_signs(0.9)) < 0.1


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((9, 64)).astype(np.float32)
    y = V.hadamard(x)
    matrix = V.hadamard(np.eye(64, dtype=np.float32))
    assert np.allclose((x**2).sum(1), (y**2).sum(1), rtol=1e-4) and np.allclose(y, x @ matrix, atol=1e-4) and np.allclose(matrix @ matrix.T, np.eye(64), atol=1e-5)


def test_groups_of_chains_stars_and_pairs(spark):
    links = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 900)] + [(2000 - k, 1000 + k) for k in range(50)] + [(7, 7), (3, 4), (4, 3), (4, 5)]
    r = np.random.default_rng(8)
    links += [(int(a), int(b)) for a, b in r.integers(3000, 3400, (380, 2))] + [(9000, k) for k in range(8000, 8100)] + [(k, 9001) for k in range(8050, 8200)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {x: root(x) for x in up if root(x) != x}
    got = {r.node: r.root for r in G.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == want
    assert G.components(spark.createDataFrame([], "a long, b long")).collect() == []
