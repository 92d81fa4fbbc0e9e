"""The boosting families against a plain booster that tries every threshold of raw values."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import boosting, forest, trees, tuning
from tarn.operators.boosting import Job, Params, train_jobs

R = np.random.default_rng(5)


def data(n=240, missing=0.1):
    x = R.normal(size=(n, 3)).round(2)
    c = R.integers(0, 6, n)
    y = np.clip(np.where(x[:, 0] > 0.3, 2.0, 0.5) + 0.7 * x[:, 1] * (c % 2) + R.normal(size=n) * 0.2, 0, 5)
    x[R.random((n, 3)) < missing] = np.nan
    return x, np.array([f"r{v}" for v in c]), y, R.uniform(0.5, 1.5, n)  # no two halves of them weigh the same


def frame(spark, x, c, y, w, held=None):
    held = np.zeros(len(y), bool) if held is None else held
    rows = [(*(None if np.isnan(v) else float(v) for v in a), b, float(t), float(u), bool(h)) for a, b, t, u, h in zip(x, c, y, w, held, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, region string, y double, w double, held boolean").repartition(3)


class Plain:
    """Strictly one split after the other, on raw rows, with sums taken anew for each threshold."""

    def __init__(self, x, c, y, w, p):
        self.x, self.c, self.y, self.w, self.p = x, c, y, w, p
        order = np.argsort(y)
        cum = np.cumsum(w[order])
        median = y[order][np.searchsorted(cum, cum[-1] / 2)]
        self.base = np.average(y, weights=w) if p.loss == "squared" else median
        self.limits = []
        for f in range(x.shape[1]):
            v = np.unique(x[~np.isnan(x[:, f]), f])
            self.limits.append((v[1:] + v[:-1]) / 2)
        self.pred = np.full(len(y), self.base)
        for _ in range(p.trees):
            self.tree()

    def score(self, rows, more=0.0):
        g, h = self.g[rows].sum(), self.h[rows].sum() + self.p.l2 + more
        return (np.sign(g) * max(abs(g) - self.p.l1, 0)) ** 2 / h if h > 0 else 0.0

    def ok(self, *sides):
        return all(s.sum() >= max(1, self.p.least_rows) and self.h[s].sum() >= self.p.least_hessian for s in sides)

    def splits(self):
        for f, limits in enumerate(self.limits):
            nan = np.isnan(self.x[:, f])
            for missing_left in (False, True):
                for t in limits:
                    yield np.where(nan, missing_left, self.x[:, f] <= t)

    def category_splits(self, rows):
        there = np.unique(self.c[rows])
        means = {k: self.g[rows & (self.c == k)].sum() / (self.h[rows & (self.c == k)].sum() + 10) for k in there}
        order = sorted(there, key=means.get)
        for side in (order, order[::-1]):
            for k in range(1, len(side)):
                yield np.isin(self.c, side[:k])

    def best(self, rows):
        found = (1e-12, None)
        for go in self.splits():
            a, b = rows & go, rows & ~go
            if self.ok(a, b):
                found = max(found, (self.score(a) + self.score(b) - self.score(rows), (a, b)), key=lambda s: s[0])
        if self.p.category:
            for go in self.category_splits(rows):
                a, b = rows & go, rows & ~go
                if self.ok(a, b):
                    found = max(found, (self.score(a, 10.0) + self.score(b, 10.0) - self.score(rows), (a, b)), key=lambda s: s[0])
        return found

    def tree(self):
        off = self.pred - self.y
        self.g = self.w * (off if self.p.loss == "squared" else np.sign(off))
        self.h = self.w.copy()
        leaves = [np.ones(len(self.y), bool)]
        if self.p.growth == "leaf":
            while len(leaves) < self.p.leaves:
                gains = [self.best(r) for r in leaves]
                k = max(range(len(leaves)), key=lambda i: gains[i][0])
                if gains[k][1] is None:
                    break
                leaves[k : k + 1] = gains[k][1]
        elif self.p.growth == "level":
            for _ in range(self.p.depth):
                leaves = [s for r in leaves for s in (self.best(r)[1] or (r,))]
        else:
            for _ in range(self.p.depth):
                gain = lambda go: sum(self.score(r & go) + self.score(r & ~go) - self.score(r) for r in leaves)
                go = max(self.splits(), key=gain)
                leaves = [s for r in leaves for s in (r & go, r & ~go)]
        for r in leaves:
            if not r.any():
                continue
            if self.p.loss == "squared":
                g, h = self.g[r].sum(), self.h[r].sum() + self.p.l2
                value = -np.sign(g) * max(abs(g) - self.p.l1, 0) / h
            else:
                rest = self.y[r] - self.pred[r]
                order = np.argsort(rest)
                cum = np.cumsum(self.w[r][order])
                value = rest[order][np.searchsorted(cum, cum[-1] / 2)]
            self.pred[r] += self.p.rate * value


FAMILIES = {
    "leaf": Params("leaf", "squared", 4, 0.3, leaves=6, depth=0, least_rows=8, l1=0.1, l2=0.1, category=True),
    "level": Params("level", "squared", 4, 0.3, depth=3, least_hessian=9.0, l1=0.1, l2=1.0),
    "symmetric": Params("symmetric", "absolute", 3, 0.5, depth=3, l2=3.0),
    "leaf_absolute": Params("leaf", "absolute", 3, 0.5, leaves=5, depth=0, least_rows=5),
}


@pytest.mark.parametrize("name", FAMILIES)
def test_equals_plain_booster(spark, name):
    x, c, y, w = data()
    p = FAMILIES[name]
    df = frame(spark, x, c, y, w)
    model = train_jobs(df, ["a", "b", "c"], ["y"], [Job(0, 1, p)], "region", ["w"])
    assert len(model.trees[0]) == p.trees
    got = model.predict(df).select("a", "b", "c", "region", "y", F.col("predictions")[0]).collect()
    want = {}
    for a, k, t, v in zip(x, c, y, Plain(x, c, y, w, p).pred, strict=True):
        want.setdefault((*(None if np.isnan(u) else u for u in a), k, t), v)
    for r in got:
        assert abs(r[5] - want[tuple(r)[:5]]) < 1e-4


def test_second_order_weights():
    p = Params(l1=0.5, l2=2.0)
    assert trees.weight(-3.0, 4.0, p) == pytest.approx(2.5 / 6.0) and trees.weight(0.4, 4.0, p) == 0.0 and trees.weight(3.0, 4.0, p) == pytest.approx(-2.5 / 6.0)


def test_jobs_in_lockstep_equal_single_ones_and_partitions_do_not_matter(spark, monkeypatch):
    x, c, y, w = data(400)
    df = frame(spark, x, c, y, w).withColumn("z", 5 - F.col("y"))
    jobs = [Job(t, s, FAMILIES[n] if n != "drawn" else Params("level", "squared", 4, 0.3, depth=3, rows=0.7, columns=0.6)) for t, s, n in ((0, 1, "leaf"), (1, 2, "level"), (1, 3, "symmetric"), (0, 4, "drawn"))]
    both = train_jobs(df, ["a", "b", "c"], ["y", "z"], jobs, "region")
    monkeypatch.setattr(boosting, "PASS_BYTES", 1)  # a node a pass
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    monkeypatch.setattr(boosting, "REFRESH", 1)
    for j, job in enumerate(jobs):
        alone = train_jobs(df.repartition(7), ["a", "b", "c"], ["y", "z"], [job], "region")
        rows = both.predict(alone.predict(df, "alone"), "both").collect()
        assert all(abs(r.alone[0] - r.both[j]) < 1e-6 for r in rows)
    assert len({str(t.feature) for t in both.trees[3]}) > 1


def test_early_stop_keeps_the_best(spark):
    x, c, y, w = data(600)
    held = np.arange(600) % 4 == 0
    df = frame(spark, x, c, y, w, held)
    p = Params("leaf", "squared", 40, 0.5, leaves=20, depth=0, patience=5)
    model = train_jobs(df, ["a", "b", "c"], ["y"], [Job(0, 1, p)], held="held")
    n = len(model.trees[0])
    error = lambda m: m.predict(df.filter("held")).select(F.avg(F.abs(F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.col("predictions")[0])) - F.col("y")))).first()[0]
    assert 0 < n < 40
    longer = error(boosting.Boosted(model.names, model.category, model.binning, model.codes, model.jobs, model.base, [model.trees[0][:-1]]))
    assert error(model) < longer


def test_edges_and_summaries(spark):
    v, w = np.arange(10.0), np.ones(10)
    assert list(boosting.edges_of(v, w, 10)) == [i + 0.5 for i in range(9)]
    heavy = np.where(v == 3, 100.0, 1.0)
    assert list(boosting.edges_of(v, heavy, 3)) == [3.0]  # both cuts fall on the heavy value
    values = R.normal(size=50_000)
    v, w = boosting._merged(values, np.ones(50_000), 1000)
    assert len(v) <= 1000 and w.sum() == 50_000
    edges = boosting.edges_of(v, w, 20)
    assert np.abs(np.searchsorted(np.sort(values), edges) / 50_000 - np.arange(1, 20) / 20).max() < 0.003


def test_ordered_target_mean(spark):
    rows = [(k, i, float(R.integers(0, 6)) if i % 9 else None) for k in ("a", "b", None) for i in range(300 if k else 3)] + [("c", 0, None)]
    df = spark.createDataFrame(rows, "region string, i long, y double").repartition(3)
    got = {(r.region, r.i): r.target_mean for r in boosting.ordered_target_mean(df, "region", "y", ["i"]).collect()}
    prior = np.mean([y for _, _, y in rows if y is not None])
    place = lambda r: hashlib.md5(":".join(str(v) for v in (r[0], r[1], 42) if v is not None).encode()).hexdigest()
    for k in ("a", "b", "c", None):
        s, n = 0.0, 0
        for r in sorted((r for r in rows if r[0] == k), key=place):
            assert got[r[0], r[1]] == pytest.approx((s + prior) / (n + 1))
            if r[2] is not None:
                s, n = s + r[2], n + 1
    assert len(got) == len(rows)


def test_ordered_target_means_leak_nothing(spark):
    """Targets that know nothing of the region: means that saw their own target would explain them, ordered ones don't."""
    draw = random.Random(1)
    rows = [(f"r{i % 300}", i, draw.uniform(0, 5)) for i in range(1200)]
    df = spark.createDataFrame(rows, "region string, i long, y double")
    means = boosting.ordered_target_mean(df, "region", "y", ["i"]).join(df.groupBy("region").agg(F.avg("y").alias("leaky")), "region")
    assert means.agg(F.corr("leaky", "y")).first()[0] > 0.4
    assert abs(means.agg(F.corr("target_mean", "y")).first()[0]) < 0.1


def test_empty_and_missing(spark):
    x, c, y, w = data(30)
    df = frame(spark, x, c, y, w)
    none = train_jobs(df.limit(0), ["a", "b"], ["y"], [Job(0, 1, FAMILIES["level"])])
    assert [r.predictions for r in none.predict(df).collect()] == [[0.0]] * 30
    gone = df.withColumn("a", F.lit(None).cast("double")).withColumn("y", F.when(F.col("b") > 0, F.col("y")))
    model = train_jobs(gone, ["a", "b"], ["y"], [Job(0, 1, FAMILIES["leaf"])], "region")
    seen = model.predict(df.withColumn("region", F.lit(None).cast("string"))).collect()
    assert len(seen) == 30 and all(np.isfinite(r.predictions[0]) for r in seen)


# random trees


def test_drawn_thresholds(spark):
    """Thresholds differ by seed and lie between a node's least and largest values, so both sides have rows."""
    x, c, y, w = data(500, missing=0.05)
    df = frame(spark, x, c, y, w)
    p = Params(depth=5, least_rows=4, columns=0.7)
    model = forest.train_forest(df, ["a", "b", "c"], ["y"], 6, p)
    roots = {(t.feature[0], t.bin[0]) for (t,) in model.trees}
    assert len(roots) > 2
    bins = model.binning.codes(x)
    for (t,) in model.trees:
        leaf = t.leaves(bins, np.zeros(len(y), int))
        assert min(np.bincount(leaf)[[n for n, f in enumerate(t.feature) if f < 0]]) >= 4 and len(t.feature) > 15
        for n in np.unique(leaf):
            assert t.value[n] == pytest.approx(y[leaf == n].mean())
    again = forest.train_forest(df.repartition(7), ["a", "b", "c"], ["y"], 6, p)
    assert [t.feature for (t,) in again.trees] == [t.feature for (t,) in model.trees] and [t.bin for (t,) in again.trees] == [t.bin for (t,) in model.trees]


def test_thresholds_lie_between_extents():
    edges = np.array([0.0, 1.0, 2.0, 10.0])  # bins 1..5
    draws = [forest.threshold(edges, 2, 5, False, u) for u in np.linspace(0, 1, 101)]
    assert set(draws) == {2, 3, 4} and draws.count(3) > 80  # most of the span lies between 2 and 10
    assert forest.threshold(edges, 3, 3, False, 0.5) == -1 and forest.threshold(edges, 3, 3, True, 0.5) == 2


def test_random_trees_are_near_a_forest(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    x, c, y, w = data(1200, missing=0.0)
    train, test = frame(spark, x[:900], c[:900], y[:900], w[:900]), frame(spark, x[900:], c[900:], y[900:], w[900:])
    mine = forest.train_forest(train, ["a", "b", "c"], ["y"], 20, Params(depth=8, least_rows=5, columns=1.0)).predict(test)
    error = mine.select(F.avg(F.abs(F.aggregate("predictions", F.lit(0.0), lambda s, v: s + v) / 20 - F.col("y")))).first()[0]
    made = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x")
    other = RandomForestRegressor(numTrees=20, maxDepth=8, seed=1, labelCol="y", featuresCol="x", featureSubsetStrategy="all").fit(made.transform(train)).transform(made.transform(test))
    assert error < 1.2 * other.select(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]


# guided search


def test_sampler_beats_chance():
    """The least of a fixed function after 40 trials, over 30 seeds."""
    loss = lambda p: (p[0] - 0.13) ** 2 + (p[1] - 0.77) ** 2 + 0.5 * abs(p[2] - 0.4)
    guided, chance = [], []
    for seed in range(30):
        sampler = tuning.Parzen(3, seed)
        for _ in range(40):
            p = sampler.ask()
            sampler.tell(p, loss(p))
        guided.append(min(sampler.losses))
        chance.append(min(map(loss, np.random.default_rng(seed).random((40, 3)))))
    assert np.mean(guided) < 0.6 * np.mean(chance) and np.mean(np.array(guided) < chance) > 0.7


def test_search_space():
    at = tuning.SPACE["rate"].at
    assert (at(0.0), at(1.0)) == pytest.approx((0.01, 0.1)) and at(0.5) == pytest.approx(0.1**1.5)
    assert tuning.SPACE["leaves"].at(0.5) == 143


def test_tune_gives_up_hopeless_trials(spark):
    x, c, y, w = data(300)
    df = frame(spark, x, c, y, w, np.arange(300) % 3 == 0)
    base = Params("leaf", "squared", 9, depth=0, patience=9)
    best, loss = tuning.tune(df, ["a", "b", "c"], "y", "held", base, 4, 4, {"rate": tuning.Range(0.001, 0.4, log=True), "leaves": tuning.Range(2, 9, whole=True)})
    assert set(best) == {"rate", "leaves"} and 0 < loss < np.abs(y - np.median(y)).mean()
    assert boosting._hopeless([[3.0] * 9, [2.0] * 9], [[1.0] * 9], 0, 6) and not boosting._hopeless([[1.0] * 9, [2.0] * 9], [[1.5] * 9], 0, 6)
    assert not boosting._hopeless([[3.0] * 9, [2.0] * 9], [[1.0] * 9], 0, boosting.WARM_UP - 1)
