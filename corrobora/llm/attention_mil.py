"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages (its lines). Each passage is encoded by a small learnt layer; gated attention gives
it a weight, learnt from the labels of whole texts; the weighted sum of the codes is scored. Fitting uses a
bounded sample of labelled texts; scoring reads every passage of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corrobora.llm.quality_lines import LineReader, in_pieces, labelled_lines


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -30, 30)))


@dataclass
class AttentionModel:
    """Scaling of the features, and the weights by name."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
        """All values between passages ``x`` (bags start at ``firsts``) and the bags' scores ``p``."""
        w = self.w
        of = np.repeat(np.arange(len(firsts)), np.diff([*firsts, len(x)]))
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ w["code"] + w["code_bias"])
        t, g = np.tanh(h @ w["view"]), _sigmoid(h @ w["gate"])
        a = (t * g) @ w["attend"]
        e = np.exp(a - np.maximum.reduceat(a, firsts)[of])
        a = e / np.add.reduceat(e, firsts)[of]
        bag = np.add.reduceat(a[:, None] * h, firsts, axis=0)
        p = _sigmoid(bag @ w["score"] + w["score_bias"])
        return {"of": of, "z": z, "h": h, "t": t, "g": g, "a": a, "bag": bag, "p": p}


def fit_model(
    x: np.ndarray, firsts: np.ndarray, y: np.ndarray, hidden: int = 16, views: int = 8, rounds: int = 200, seed: int = 7
) -> AttentionModel:
    """Cross-entropy of the bags, equal weight for both labels, by Adam with gradients written out."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    shapes = {"code": (n, hidden), "view": (hidden, views), "gate": (hidden, views), "attend": (views,), "score": (hidden,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    w |= {"code_bias": np.zeros(hidden), "score_bias": np.zeros(1)}
    if not len(y):
        # Nothing to learn from: every text scores one half.
        return AttentionModel(np.zeros(n), np.ones(n), w | {"score": np.zeros(hidden)})
    model = AttentionModel(x.mean(axis=0), x.std(axis=0) + 0.05, w)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for step in range(1, rounds + 1):
        f = model.forward(x, firsts)
        d = (f["p"] - y) * share
        grad = {"score": f["bag"].T @ d, "score_bias": np.array([d.sum()])}
        d_bag = (d[:, None] * w["score"])[f["of"]]
        pull = (d_bag * f["h"]).sum(axis=1)
        d_a = f["a"] * (pull - np.add.reduceat(f["a"] * pull, firsts)[f["of"]])
        grad["attend"] = (f["t"] * f["g"]).T @ d_a
        both = d_a[:, None] * w["attend"]
        d_t, d_g = both * f["g"] * (1 - f["t"] ** 2), both * f["t"] * f["g"] * (1 - f["g"])
        grad["view"], grad["gate"] = f["h"].T @ d_t, f["h"].T @ d_g
        d_h = (f["a"][:, None] * d_bag + d_t @ w["view"].T + d_g @ w["gate"].T) * (1 - f["h"] ** 2)
        grad["code"], grad["code_bias"] = f["z"].T @ d_h, d_h.sum(axis=0)
        for k, a in w.items():
            g = grad[k] + 1e-4 * a
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            w[k] = a - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, id: str = "doc_id", text: str = "text") -> AttentionModel:
    """The model of at most ``per_class`` labelled texts of either quality, none of them held out."""
    return fit_model(*labelled_lines(docs, labels, per_class, id, text))


def scored(docs: DataFrame, model: AttentionModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of ``text`` in column ``name``: 0 to 1, higher for label 1.

    A null or empty text, or one of white space, is a bag of one empty passage and gets that bag's score.
    Every row is scored by its text alone, so repeated rows score alike.
    """

    @arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        reader, out = LineReader(), []
        for part in in_pieces([t or "" for t in column.to_pylist()]):
            x, _, firsts = reader.read(part)
            out.extend(model.forward(x.astype(np.float64), firsts)["p"].tolist())
        return pa.array(out, pa.float64())

    return docs.withColumn(name, score(F.col(text).cast("string")))
