"""The fitted models: held-out quality, determinism, targets met."""

import zlib

import numpy as np

from linemill.llm import mixing, quality, queries
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op7_quality(spark, SF).collect()}
    assert len(got) == 1000
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    again = {r.doc_id: r.score for r in queries.op7_quality(spark, SF).collect()}
    assert max(abs(again[i] - r.score) for i, r in got.items()) < 1e-6


def test_quality_of_awkward_tables(spark):
    labels = spark.createDataFrame([(i, i % 3 > 0, 0) for i in range(0, 100, 2)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "cast(quality as int) as quality", "toxic")
    for lab in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality.quality_report(cases.frame(spark), lab).collect()
        assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_report(cases.empty(spark), labels).count() == 0
    assert quality.keep_good(cases.frame(spark), labels).columns == cases.frame(spark).columns


def test_non_negative_fit_finds_the_prior():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 0.5, (2000, 3)), np.concatenate((rng.normal(1, 0.5, (1400, 3)), rng.normal(-1, 0.5, (600, 3))))
    model = quality.fit_non_negative(p, u)
    assert abs(model.prior - 0.7) < 0.06
    assert model.score(p).mean() > 0.9 and model.score(u[1400:]).mean() < 0.1


def test_mixture_meets_its_targets(spark):
    targets = {"prose": 0.9, "toxic": 0.04, "low": 0.06}
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = mixing.mixture_report(docs, labels, targets, 0.7).toPandas()
    total = got.n_tokens.sum()
    for d in mixing.DOMAINS:
        assert abs((got.rate * got.n_tokens * got[f"p_{d}"]).sum() / total - 0.7 * targets[d]) < 0.005
    assert (got.rate >= 0).all() and (got.copies - got.rate).abs().max() < 1 and len(got) == 1000
    labelled = got.merge(labels.toPandas(), on="doc_id")
    held = labelled[[zlib.crc32(str(i).encode()) % 4 == 2 for i in labelled.doc_id]]
    truth = np.where(held.toxic == 1, "toxic", np.where(held.quality == 0, "low", "prose"))
    assert np.mean(held[[f"p_{d}" for d in mixing.DOMAINS]].idxmax(axis=1).str[2:].to_numpy() == truth) > 0.85


def test_rates_like_plain_projected_gradient(spark):
    rng = np.random.default_rng(2)
    t, p = rng.integers(1, 500, 300), rng.dirichlet((1, 1, 1), 300)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "_lm_tokens long, _lm_p array<double>")
    targets = {"prose": 0.5, "toxic": 0.3, "low": 0.2}
    residuals, share = mixing.fit_rates(df, targets, 0.5)
    r = np.ones(300)
    for _ in range(len(residuals)):
        r = np.maximum(0, r - p @ ((t * r) @ p / t.sum() - np.array([0.25, 0.15, 0.1])))
    assert np.allclose(r, mixing.rate_of(p, residuals), atol=1e-9)
    assert max(abs(share[d] - 0.5 * targets[d]) for d in mixing.DOMAINS) < 0.01


def test_mixing_awkward_tables(spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 100)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        assert mixing.mixture_report(cases.frame(spark), lab).count() == len(cases.rows())
    assert mixing.mixture_report(cases.empty(spark), labels).count() == 0
    assert {"doc_id", "text", "rate", "copies", "chunk"} <= set(mixing.mix(cases.frame(spark), labels).columns)
    mixed = mixing.mix(cases.frame(spark), labels)
    assert mixed.columns == [*cases.frame(spark).columns, "n_tokens", "p_prose", "p_toxic", "p_low_", "rate_", "copies_"]
    assert {(r.rate, r.copies) for r in mixed.collect()} == {cases.EXTRA[3:5]}


def test_columns_of_the_operators_own_names(spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 100)], "doc_id long, quality int, toxic int")
    df = cases.frame(spark).selectExpr("*", "1 as _lm_score", "2 as _lm_tokens", "3 as _lm_p")
    assert quality.keep_good(df, labels).columns == df.columns
    assert {(r._lm_tokens, r._lm_p) for r in mixing.mix(df, labels).collect()} == {(2, 3)}


def test_non_negative_risk_like_a_plain_computation():
    """A slow restatement of the fit: losses and gradients by finite differences, one coordinate at a time."""
    rng = np.random.default_rng(7)
    p, u, prior = rng.normal(0.8, 0.6, (40, 2)), rng.normal(0, 1, (60, 2)), 0.6
    model = quality.fit_non_negative(p, u, prior)
    z = lambda x, w: model.scale(x) @ w
    loss = lambda s: np.mean(np.log1p(np.exp(-s)))  # noqa: E731  of a score that should be positive

    def parts(w):
        return prior * loss(z(p, w)), loss(-z(u, w)) - prior * loss(-z(p, w))

    def objective(w, back):
        positive, negative = parts(w)
        return (positive + negative if not back else -negative) + quality.DECAY / 2 * w @ w

    w, m, v = np.zeros(3), np.zeros(3), np.zeros(3)
    for t in range(1, quality.STEPS + 1):
        back = parts(w)[1] < 0
        g = np.array([(objective(w + 1e-5 * e, back) - objective(w - 1e-5 * e, back)) / 2e-5 for e in np.eye(3)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - quality.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.abs(w - model.weights).max() < 1e-3


def test_production_targets_of_rare_domains(spark):
    rng = np.random.default_rng(3)
    for shares, soft in (((0.98, 0.01, 0.01), 0.0), ((0.94, 0.05, 0.01), 0.1), ((0.997, 0.002, 0.001), 0.0), ((0.94, 0.05, 0.01), 0.0)):
        t, kind = rng.integers(50, 500, 4_000), rng.choice(3, 4_000, p=shares)
        p = (1 - soft) * np.eye(3)[kind] + soft * rng.dirichlet((8, 1, 1), 4_000) * (kind == 0)[:, None] + soft * np.eye(3)[kind] * (kind > 0)[:, None]
        df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "_lm_tokens long, _lm_p array<double>").coalesce(1)
        steps, share = mixing.fit_rates(df, mixing.TARGETS, mixing.BUDGET)
        held = (t * mixing.rate_of(p, steps)) @ p / t.sum()
        for i, d in enumerate(mixing.DOMAINS):
            goal = mixing.BUDGET * mixing.TARGETS[d]
            assert abs(held[i] / goal - 1) < 0.02 and abs(share[d] - held[i]) < 1e-9, (shares, d, held[i], len(steps))


def test_targets_that_no_document_can_meet(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 1.0])], "_lm_tokens long, _lm_p array<double>")
    _, share = mixing.fit_rates(df, mixing.TARGETS, mixing.BUDGET)
    assert abs(share["prose"] - 0.76) < 1e-3 and share["toxic"] == 0 and abs(share["low"] / 0.032 - 1) < 0.02


def test_what_the_mixture_reaches_is_told(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.domain: r for r in mixing.mixture_shares(docs, labels).collect()}
    assert set(got) == set(mixing.DOMAINS) and all(r.met and abs(r.reached - mixing.BUDGET * mixing.TARGETS[d]) < 1e-4 for d, r in got.items())
    none = {r.domain: r for r in mixing.mixture_shares(docs, labels.where("toxic = 0")).collect()}
    assert not none["toxic"].met and none["toxic"].reached < none["toxic"].target


def test_posteriors_like_a_plain_computation():
    """The same regression, one document at a time."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 1, (60, 2)), rng.integers(0, 3, 60)
    x[:, 0] += y
    shares = np.array([0.7, 0.2, 0.1])
    model = mixing.fit_posterior(x, y, np.zeros(0, np.uint64), shares)
    z, sizes, w, m, v = model.scale(x), np.bincount(y, minlength=3), np.zeros((3, 3)), 0, 0
    for t in range(1, 301):
        g = 1e-4 * w
        for row, label in zip(z, y, strict=True):
            e = np.exp(row @ w)
            g = g + np.outer(row, e / e.sum() - np.eye(3)[label]) / (sizes[label] * 3)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.abs(w - model.weights).max() < 1e-6 and np.allclose(model.shift, np.log(shares))
