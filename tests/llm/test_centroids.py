import hashlib
import math
import random

import numpy as np
import pytest

from episodica.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, label int"


def lloyd(rows, k=8, rounds=10, dims=64):
    """Plain k-means in whole numbers: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept rows."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    means = [list(v) for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(means)) for _, v in kept]

    for _ in range(rounds):
        at = [j for _, j in assign()]
        for j in set(at):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            means[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = assign()
    total = {j: sum(d for d, a in out if a == j) for _, j in out}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means]
    return [(i, j, d, total[j], sum(total.values()), sha[j]) for (i, _), (d, j) in zip(kept, out, strict=True)]


def same(spark, rows, told=None, **args):
    got = centroids.cluster(spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(3), told=told, **args)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(lloyd(rows, **args), key=key)


def test_equal_to_plain_k_means(spark):
    rng = random.Random(2)
    heart = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    rows = [(k, [x + rng.gauss(0, 0.5) for x in rng.choice(heart)]) for k in range(600)]
    rows += [(1, rows[1][1])] * 3 + [(1, rows[2][1]), (None, rows[3][1]), (None, rows[5][1])]
    odd = [math.nan, math.inf, -math.inf, None]
    rows += [(900 + k, [x, *[0.0] * 63]) for k, x in enumerate(odd)] + [(950, None), (951, []), (952, [1.0] * 63), (953, [1.0] * 65), (954, [-0.0] * 64), (955, [1e-9] * 64), (956, [-1e-9] * 64)]
    told = []
    same(spark, rows, told)
    # after the first assignments the filters leave few distances to take
    assert told[0] == 8 * 609 and sum(told[5:]) < 0.35 * 5 * told[0]


def test_ties_copies_and_few(spark):
    same(spark, [(k, [float(k % 2)] * 64) for k in range(40)])
    same(spark, [(k, [0.5] * 64) for k in range(20)])
    same(spark, [(k, [k / 7] * 64) for k in range(5)])
    grid = [(k, [(k % 3) / 4, (k // 3 % 3) / 4, (k // 9 % 3) / 4, (k // 27) / 4, *[0.0] * 60]) for k in range(81)]
    same(spark, grid)
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None, None, None)], SCHEMA)).count() == 0


def test_huge_components_have_a_defined_distance(spark):
    rows = [(k, [1e300 if k else -1e300] * 64) for k in range(2)]
    got = centroids.cluster(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()
    assert [r["distance"] for r in got] == [0, 0]


@pytest.mark.parametrize("k", [1, 3, 17])
def test_bounds_of_all_rounds_hold(k):
    """After each round: the cluster is the nearest, the upper bound is no less, the lower bounds no more than the true distances."""
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.integers(-50, 50, (300, 6)), rng.integers(-2, 2, (100, 6))]).astype(np.int32)
    means = x[:k].astype(np.int64)
    of, before, state, taken = centroids.groups(means, -(-k // 3)), None, None, []
    for _ in range(12):
        step = centroids.Round(means, of, before)
        cluster, upper, lower, n = step.first(x) if state is None else step.next(x, *state)
        taken.append(n)
        d = ((x[:, None].astype(np.int64) - means[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all() and (upper >= np.sqrt(d.min(1))).all()
        for g in range(step.n_groups):
            for j in np.flatnonzero(of == g):
                assert (lower[:, g][cluster != j] <= np.sqrt(d[cluster != j, j])).all()
        state, before = (cluster, upper, lower), means
        means = np.stack([x[cluster == j].sum(0) // (cluster == j).sum() if (cluster == j).any() else means[j] for j in range(k)])
    assert k == 1 or sum(taken[1:]) < 11 * taken[0]
