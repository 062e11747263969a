"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

The field has two states. It is fitted by maximum likelihood on all labelled texts: they are dealt into shares of a
bounded number of lines, each share gives a field, and the field is their mean. Lines of good texts are content; lines
of bad texts are boilerplate, save those that a line-wise logistic fit of the same share holds for content. Viterbi decoding labels every line of every text, and a text is kept if lines
of content hold at least ``least_share`` of its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corrobora.llm.common import written
from corrobora.llm.quality_lines import FEATURES, SYMBOLS, LineReader, in_pieces, labelled_runs

BLANK = " \t\n\r\x0b\x0c"
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " content_share double, kept boolean"
)


@dataclass
class Field:
    """Emission weights of content against boilerplate (bias last), and scores of the steps between states."""

    emission: np.ndarray
    steps: np.ndarray  # [from, to]; 0 is boilerplate, 1 is content


def default_field() -> Field:
    """What stands in where no labelled text of both kinds exists: marks of boilerplate count against a line."""
    w = dict.fromkeys(FEATURES, 0.0) | {"symbols": -4, "pipes": -4, "marks": -4, "upper": -6, "repeats": -6, "other": -4}
    return Field(np.array([*w.values(), 3.0]), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def _logistic(x: np.ndarray, y: np.ndarray, heavy: np.ndarray, rounds: int = 30, ridge: float = 1e-3) -> np.ndarray:
    w, total = np.zeros(x.shape[1]), heavy.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (heavy * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * total * np.eye(x.shape[1])
        w += np.linalg.solve(hess, x.T @ (heavy * (y - p)) - ridge * total * w)
    return w


def fit_field(
    features: np.ndarray, firsts: np.ndarray, quality: np.ndarray, rounds: int = 60, weights: np.ndarray | None = None,
) -> Field:
    """Maximum likelihood by forward-backward sums over all sequences at once, with Adam steps; ``weights`` are of sequences."""
    if not len(quality) or quality.min() == quality.max():
        return default_field()
    lengths = np.diff([*firsts, len(features)])
    x = np.hstack([features, np.ones((len(features), 1))])
    given = np.repeat(quality, lengths)
    weights = np.ones(len(lengths)) if weights is None else weights
    heavy = np.repeat(weights, lengths)
    alone = _logistic(x, given, heavy)
    label = np.where((given == 0) & (x @ alone > 0), 1.0, given).astype(int)

    # Lines stand by their place in the text and texts by falling length, so a step works on a text's lines only.
    by_length = np.argsort(-lengths, kind="stable")
    span, starts = int(lengths.max()), np.asarray(firsts)[by_length]
    inside = np.arange(span)[:, None] < lengths[by_length]
    active = inside.sum(axis=1)
    rows = (starts + np.arange(span)[:, None])[inside]
    x, label, heavy = x[rows], label[rows], heavy[rows]
    y = np.zeros(inside.shape, int)
    y[inside] = label
    both = inside[1:]
    steps_of = np.broadcast_to(weights[by_length], both.shape)[both]
    seen = np.bincount(2 * y[:-1][both] + y[1:][both], weights=steps_of, minlength=4)
    theta = np.concatenate([alone, np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    # Of two states the log odds are enough: s of the line alone, r with the lines before it, b of the lines after it.
    s, r, b = (np.zeros(inside.shape) for _ in range(3))
    for step in range(1, rounds + 1):
        w, (t00, t01, t10, t11) = theta[:-4], theta[-4:]
        s[inside] = x @ w
        r[0] = s[0]
        for k in range(1, span):
            before = r[k - 1, : active[k]]
            r[k, : active[k]] = s[k, : active[k]] + np.logaddexp(t01, t11 + before) - np.logaddexp(t00, t10 + before)
        for k in range(span - 2, -1, -1):
            ahead = s[k + 1, : active[k + 1]] + b[k + 1, : active[k + 1]]
            b[k, : active[k + 1]] = np.logaddexp(t10, t11 + ahead) - np.logaddexp(t00, t01 + ahead)
        content = 1 / (1 + np.exp(-np.clip((r + b)[inside], -500, 500)))
        left, right = r[:-1][both], (s + b)[1:][both]
        pair = np.stack([np.full(len(left), t00), t01 + right, t10 + left, t11 + left + right])
        pair = np.exp(pair - pair.max(axis=0, initial=-np.inf))
        pair = (pair / pair.sum(axis=0) * steps_of).sum(axis=1)
        grad = np.concatenate([x.T @ (heavy * (label - content)), seen - pair]) / heavy.sum() - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def viterbi(scores: list[float], steps: list[list[float]]) -> list[int]:
    """Best states of one text: ``scores`` are those of content against boilerplate; ties go to content."""
    (t00, t01), (t10, t11) = steps
    back: list[tuple[int, int]] = []
    a, b = 0.0, scores[0]
    for s in scores[1:]:
        to0 = (a + t00, 0) if a + t00 > b + t10 else (b + t10, 1)
        to1 = (a + t01, 0) if a + t01 > b + t11 else (b + t11, 1)
        back.append((to0[1], to1[1]))
        a, b = to0[0], to1[0] + s
    state = 0 if a > b else 1
    path = [state]
    for step in reversed(back):
        state = step[state]
        path.append(state)
    return path[::-1]


def repeated_words(words: list, width: int = 3) -> int:
    """Words that stand in a window of ``width`` words found twice or more, all its places included."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    key, base = a[: n - width + 1], len(ids)
    for k in range(1, width):
        # Names of windows stay below the text's length, so that their product with a word fits 64 bits.
        key = np.unique(key * base + a[k : n - width + 1 + k], return_inverse=True)[1]
    often = np.bincount(key)[key] > 1
    cover = np.zeros(n, bool)
    for k in range(width):
        cover[k : n - width + 1 + k] |= often
    return int(cover.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(BLANK):
            seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), again, repeated_words(words)
    )


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", share_lines: int = 20_000) -> Field:
    """The field of all labelled texts, where good and bad ones weigh the same: the mean of the fields of their shares.

    A share holds about ``share_lines`` lines, drawn by a hash of the ids, and is fitted in one task; the driver gets 17
    numbers for each. Without texts of both kinds the default field stands in.
    """
    runs = written(labelled_runs(docs, labels, id, text), "labelled_runs")
    of = {r.quality: r for r in runs.groupBy("quality").agg(F.sum("n").alias("lines"), F.count_if(F.col("at") == 0).alias("texts")).collect()}
    if len(of) < 2:
        return default_field()
    balance = {q: sum(r.texts for r in of.values()) / (2 * r.texts) for q, r in of.items()}
    shares = -(-sum(r.lines for r in of.values()) // share_lines)

    def fitted(group: pa.Table) -> pa.Table:
        ids, at, lines, quality = (group.column(c).to_pylist() for c in ("id", "at", "lines", "quality"))
        order = sorted(range(len(ids)), key=lambda k: (str(ids[k]), at[k], lines[k]))
        parts = [np.frombuffer(lines[k], np.float32).reshape(-1, len(FEATURES)) for k in order]
        good = np.array([quality[k] for k in order], np.float64)
        both = good.min() != good.max()
        firsts = np.cumsum([0, *map(len, parts)])[:-1]
        field = fit_field(np.concatenate(parts).astype(np.float64), firsts, good, weights=np.where(good == 1, balance[1], balance[0]))
        values = np.concatenate([field.emission, field.steps.ravel()])
        return pa.table({"both": [both], "values": pa.array([values.tolist()], pa.list_(pa.float64()))})

    # A number of partitions that is asked for is not coalesced: the work is far larger than the rows.
    dealt = runs.withColumn("share", F.pmod(F.xxhash64("id", "at"), F.lit(shares))).repartition(int(min(shares, 2000)), "share")
    fields = [r["values"] for r in dealt.groupBy("share").applyInArrow(fitted, "both boolean, values array<double>").where("both").collect()]
    if not fields:
        return default_field()
    mean = np.array(sorted(fields)).mean(axis=0)
    return Field(mean[:-4], mean[-4:].reshape(2, 2))


def judge(
    docs: DataFrame, field: Field, text: str = "text", least_words: int = 50, least_share: float = 0.5,
    name: str = "quality",
) -> DataFrame:
    """``docs`` with a struct column ``name``: the base counts, ``base_failed``, ``content_share`` and ``kept``.

    A null or empty text, or one of white space, has no words: it fails the base rules, and its share is 0.
    Rows are judged one by one, so repeated rows and null ids are judged like any other.
    """
    weights, steps = field.emission, field.steps.tolist()

    @arrow_udf(RESULT)
    def judged(column: pa.Array) -> pa.Array:
        reader, out = LineReader(), []
        for part in in_pieces([t or "" for t in column.to_pylist()]):
            features, words, firsts = reader.read(part)
            scores = (features @ weights[:-1] + weights[-1]).tolist()
            for k, t in enumerate(part):
                a, b = firsts[k], firsts[k + 1] if k + 1 < len(part) else len(scores)
                counts = base_counts(t)
                path = np.array(viterbi(scores[a:b], steps))
                all_words = int(words[a:b].sum())
                share = float((words[a:b] * path).sum() / all_words) if all_words else 0.0
                failed = counts[0] < least_words or 100 * counts[4] > 50 * counts[0]
                out.append((*counts, failed, share, not failed and share >= least_share))
        columns = list(zip(*out)) if out else [()] * 8
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        names = [f.split()[0] for f in RESULT.split(",")]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.withColumn(name, judged(F.col(text).cast("string")))
