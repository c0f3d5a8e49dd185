"""Trained models against plain forms of themselves: the network by loops and differences, the forest by the fitted model."""

import math
import os

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tomeweave.llm import langid, secrets

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def a_direction(seed, h=3):
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.6, s).astype(np.float32) for s in ((256, 3 * h), (3 * h, h))]


def plain_direction(codes, inputs, recurrent):
    """States of one text by scalar loops."""
    h = recurrent.shape[1]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    state, out = [0.0] * h, []
    for c in codes:
        own = [sum(float(recurrent[g, k]) * state[k] for k in range(h)) for g in range(3 * h)]
        given = [float(x) for x in inputs[c]]
        reset = [sigmoid(given[i] + own[i]) for i in range(h)]
        update = [sigmoid(given[h + i] + own[h + i]) for i in range(h)]
        candidate = [math.tanh(given[2 * h + i] + reset[i] * own[2 * h + i]) for i in range(h)]
        state = [update[i] * state[i] + (1 - update[i]) * candidate[i] for i in range(h)]
        out.append(state)
    return np.array(out)


def test_network_against_loops():
    inputs, recurrent = a_direction(1)
    codes = np.random.default_rng(2).integers(0, 256, (11, 4))
    states = langid.run_direction(codes, inputs, recurrent)
    for n in range(codes.shape[1]):
        assert np.allclose(states[:, :, n], plain_direction(codes[:, n], inputs, recurrent), atol=1e-5)


def test_gradients_against_differences():
    inputs, recurrent = a_direction(3)
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 5, (7, 3))
    pull = rng.normal(size=(7, 3, 3)).astype(np.float32)
    loss = lambda: float((langid.run_direction(codes, inputs, recurrent).astype(np.float64) * pull).sum())
    _, kept = langid.run_direction(codes, inputs, recurrent, keep=True)
    found = langid.back_direction(codes, pull, kept, inputs, recurrent)
    for weights, grads in zip((inputs, recurrent), found, strict=True):
        for at in [(c, g) for c in range(5) for g in range(9)] if weights is inputs else list(np.ndindex(*weights.shape)):
            old, step = weights[at], 1e-2
            weights[at] = old + step
            more = loss()
            weights[at] = old - step
            less = loss()
            weights[at] = old
            assert abs((more - less) / (2 * step) - grads[at]) < 5e-3 * max(1.0, abs(float(grads[at])))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")
def test_forest_expression_equals_the_fitted_model(spark, monkeypatch):
    """On every candidate that the seeded findings hold, and on those of the given table."""
    models = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, *a, **k: models.append(fit(self, *a, **k)) or models[-1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    settings = secrets.Settings()
    dictionary = secrets.dictionary_of(docs, settings.dictionary_words)
    findings = secrets.seeded_findings(docs, settings).dropna(subset=["value", "before", "after", "label"])
    forest = secrets.train(findings, dictionary, settings)
    rows = findings.select(*secrets.features(F.col("value"), F.col("before"), F.col("after"), dictionary))
    own = rows.select(F.struct(*secrets.FEATURES).alias("c"), *secrets.FEATURES).withColumn("score", secrets.forest_score(F.col("c"), forest))
    judged = models[0].transform(VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(own.drop("c")))
    both = judged.select("score", vector_to_array("probability")[1].alias("p")).agg(F.count("*").alias("n"), F.max(F.abs(F.col("score") - F.col("p"))).alias("most")).first()
    assert both.n > 500 and both.most < 1e-9


def test_a_score_at_the_threshold_is_a_secret(spark):
    key = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    docs = spark.createDataFrame([(1, f"x {key} y")], "doc_id bigint, text string")
    at, above = ([(s,)] for s in (0.5, 0.5 - 1e-12))
    assert len(secrets.scan(docs, at, []).first().secrets) == 1 and not secrets.scan(docs, above, []).first().secrets
