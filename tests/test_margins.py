"""The margin machine against an exact kernel machine."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from cadenza.operators import learning as L


def rings(n, rng):
    """Three classes that no line parts: a core, a ring around it, and two far corners; the core is rare."""
    kind = rng.choice(3, n, p=[0.1, 0.5, 0.4])
    angle = rng.uniform(0, 2 * np.pi, n)
    r = np.where(kind == 0, 0.4, 2.0) * np.sqrt(rng.uniform(0.6, 1, n))
    x = np.stack([r * np.cos(angle), r * np.sin(angle)], axis=1)
    x[kind == 2] = rng.normal(size=(int((kind == 2).sum()), 2)) * 0.4 + np.where(rng.random((int((kind == 2).sum()), 1)) < 0.5, 3.2, -3.2)
    return x, kind


def exact(x, y, cost, rounds=400):
    """Dual coordinate ascent of the hinge loss with the kernel itself, one class against the rest; the bias is a constant in the kernel."""
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2) / x.shape[1]) + 1
    k, classes = kernel(x, x), np.unique(y)
    most = cost * len(y) / len(classes) / np.array([(y == c).sum() for c in y])
    machines = []
    for c in classes:
        s, a, f = np.where(y == c, 1.0, -1.0), np.zeros(len(y)), np.zeros(len(y))
        for _ in range(rounds):
            for i in range(len(y)):
                new = min(max(a[i] + (1 - s[i] * f[i]) / k[i, i], 0), most[i])
                f += (new - a[i]) * s[i] * k[i]
                a[i] = new
        machines.append(a * s)
    return lambda z: classes[np.argmax(np.stack([kernel(z, x) @ m for m in machines]), axis=0)]


def test_agrees_with_the_kernel(spark):
    rng = np.random.default_rng(3)
    (x, y), (z, truth) = rings(240, rng), rings(300, rng)
    rows = spark.createDataFrame([(v.tolist(), f"c{c}") for v, c in zip(x, y)], "features array<double>, label string")
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, features array<double>")
    said = dict(L.fit_margins(rows.coalesce(1), features=384).predict(held).collect())
    assert set(said) == set(range(300))
    centre, spread = x.mean(axis=0), x.std(axis=0, ddof=1)
    want = exact((x - centre) / spread, y, 10.0)((z - centre) / spread)
    assert np.mean([said[i] == f"c{c}" for i, c in enumerate(want)]) >= 0.95
    assert np.mean([said[i] == f"c{c}" for i, c in enumerate(truth)]) >= 0.9
    assert np.mean([said[i] == "c0" for i, c in enumerate(truth) if c == 0]) >= 0.8


def test_features_are_near_the_kernel(spark):
    rng = np.random.default_rng(0)
    x, y = rings(60, rng)
    rows = spark.createDataFrame([(i, v.tolist(), f"c{c}") for i, (v, c) in enumerate(zip(x, y))], "id long, features array<double>, label string")
    m = L.fit_margins(rows.select("features", "label"), features=1024)
    got = m.lifted(rows).orderBy("id").select(vector_to_array("x").alias("x"), vector_to_array("z").alias("z")).collect()
    a, z = np.array([r.x for r in got]), np.array([r.z for r in got])
    want = np.exp(-((a[:, None] - a[None]) ** 2).sum(axis=2) / 2)
    assert np.abs(z @ z.T - want).max() == pytest.approx(0, abs=0.2)
