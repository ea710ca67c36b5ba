"""Baseline selectors with one interface: fit(frame) sets selected_features_, transform(frame) keeps these (or projects)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from sieveline.frame import FeatureFrame
from sieveline.functions import kernels as K

from .causal import mutual_information
from .continuous import lasso
from .encoder import Autoencoder
from .prepare import Standardiser, prefilter
from .stats import gram


class Baseline:
    def __init__(self, k: int, seed: int = 42) -> None:
        self.k, self.seed, self.selected_features_, self.scaler = k, seed, [], Standardiser()

    def fit(self, frame: FeatureFrame) -> Baseline:
        self.selected_features_ = sorted(int(i) for i in self._choose(self.scaler.fit_transform(frame.stored())))
        return self

    def transform(self, frame: FeatureFrame) -> FeatureFrame:
        return self.scaler.transform(frame).take(self.selected_features_)

    def fit_transform(self, frame: FeatureFrame) -> FeatureFrame:
        return self.fit(frame).transform(frame)

    def _choose(self, z: FeatureFrame) -> list[int]:
        raise NotImplementedError


class Components(Baseline):
    """Principal components: the features of the greatest total loading; transform projects onto the components."""

    def _choose(self, z: FeatureFrame) -> list[int]:
        g = gram(z)
        cov = g.cross[:-1, :-1] / max(1.0, g.n - 1)
        values, vectors = np.linalg.eigh(cov)
        self.vectors = vectors[:, np.argsort(-values, kind="stable")[: min(self.k, z.p)]]
        return K.top_k(np.abs(self.vectors).sum(1), self.k)

    def transform(self, frame: FeatureFrame) -> FeatureFrame:
        z = self.scaler.transform(frame)
        names = tuple(f"component_{j}" for j in range(self.vectors.shape[1]))
        parts = [sum((F.col(f"`{c}`") * float(v) for c, v in zip(z.features, w, strict=True)), F.lit(0.0)).alias(n) for n, w in zip(names, self.vectors.T, strict=True)]
        return FeatureFrame(z.df.select("row_id", "y", *parts), names, discrete=z.discrete)


class Encoder(Baseline):
    """A variational autoencoder: the features that its latent means depend on most; transform gives these means."""

    def _choose(self, z: FeatureFrame) -> list[int]:
        z = z.stored()
        self.model = Autoencoder(min(self.k, z.p), seed=self.seed).fit(z)
        return K.top_k(self.model.saliency(z), self.k)

    def transform(self, frame: FeatureFrame) -> FeatureFrame:
        return self.model.transform(self.scaler.transform(frame))


class Lasso(Baseline):
    """L1-penalised logistic regression, one class against the rest; features of the greatest total coefficient.

    With a continuous label the least squares lasso of penalty 0.01, from cross-products.
    """

    def _choose(self, z: FeatureFrame) -> list[int]:
        if not z.discrete:
            return K.top_k(np.abs(lasso(gram(z))), self.k)
        data = VectorAssembler(inputCols=list(z.features), outputCol="sieveline_x").transform(z.df)
        n, classes = z.df.count(), z.n_classes()
        base = LogisticRegression(featuresCol="sieveline_x", labelCol="y", elasticNetParam=1.0, regParam=1.0 / max(1, n), standardization=False, maxIter=100)
        models = [base.fit(data)] if classes <= 2 else OneVsRest(classifier=base, featuresCol="sieveline_x", labelCol="y").fit(data).models
        return K.top_k(sum(np.abs(m.coefficientMatrix.toArray()).sum(0) for m in models), self.k)


def information(z: FeatureFrame) -> np.ndarray:
    out = np.zeros(z.p)
    for r in mutual_information(z).collect():
        out[r["f"]] = r["score"]
    return K.over_max(out)


def causal_scores(z: FeatureFrame, g: K.Gram, lam: float = 0.5) -> np.ndarray:
    member = np.zeros(z.p)
    member[K.markov_blanket(g)] = 1
    return K.causal_relevance(member, information(z), lam)


class Mrmr(Baseline):
    """Greedy: information less the mean correlation with the chosen."""

    weight = 1.0

    def _scores(self, z: FeatureFrame, g: K.Gram) -> np.ndarray:
        return information(z)

    def _choose(self, z: FeatureFrame) -> list[int]:
        z, at = prefilter(z, 200)
        g = gram(z)
        return [at[i] for i in K.greedy(self._scores(z, g), g.correlations(), self.k, self.weight, eta=0.0)]


class Cafe(Mrmr):
    """Greedy with causal relevance and half the penalty."""

    weight = 0.5

    def _scores(self, z: FeatureFrame, g: K.Gram) -> np.ndarray:
        return causal_scores(z, g)


class CausalDrift(Baseline):
    """The features of the greatest causal relevance."""

    def _choose(self, z: FeatureFrame) -> list[int]:
        z, at = prefilter(z, 200)
        return [at[i] for i in K.top_k(causal_scores(z, gram(z)), self.k)]


class Random(Baseline):
    def _choose(self, z: FeatureFrame) -> list[int]:
        return list(np.random.default_rng(self.seed).choice(z.p, min(self.k, z.p), replace=False))


#: In the order of reports.
BASELINES = {"PCA": Components, "VAE": Encoder, "LASSO": Lasso, "mRMR": Mrmr, "CausalDRIFT": CausalDrift, "CAFE": Cafe, "Random": Random}


def build_baseline(name: str, k: int, seed: int = 42) -> Baseline:
    return BASELINES[name](k, seed)


def selected_table(frame: FeatureFrame, selected: list[int]) -> DataFrame:
    return frame.df.sparkSession.createDataFrame([(int(f),) for f in selected], "f int")
