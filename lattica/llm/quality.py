"""Quality classifier by positive-unlabelled learning with non-negative risk.

Texts are described by the shares of their characters, and by the lengths, repetition and
variety of their words, word pairs and lines; each measure is cut at its quantiles, so that
a linear score can bend along it. The score minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss over trusted positives and unlabelled web text; where the bracket
turns negative, its own gradient is climbed instead. The class prior is estimated from the
labelled rows of the training folds if both classes occur there, else by the ratio of mean
scores of positives and unlabelled texts under a first classifier.

Training reads at most ``sample_docs`` rows of each kind from the training folds; every
whole text is scored. Labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts get the score of a text without characters; without
positives every score is 0.5; repeated label rows count once (a text labelled both ways is
no trusted positive); other columns have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, replace_columns, with_text
from .sampling import bounded_sample, fold
from .textnp import slices, words

#: Quantiles at which each measure is cut: close at both ends, where junk lies.
CUTS = (0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.25, 0.5, 0.75, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995)
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_KINDS = np.zeros(256, np.int64)  # character kinds, one for each ASCII mark
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[[9, 11, 12, 13, 32]], _KINDS[10], _KINDS[128:192], _KINDS[192:] = 1, 2, 3, 4, 5, 6, 7
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_KINDS[_MARKS] = np.arange(8, 8 + len(_MARKS))
_N_KINDS = 8 + len(_MARKS)


def _variety(hashes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's tokens: share of different ones, of the most frequent one, and of neighbours that are equal."""
    n = np.diff(where)
    owner = np.repeat(np.arange(len(n)), n)
    some = np.maximum(n, 1)
    if not len(hashes):
        zero = np.zeros(len(n))
        return zero, zero, zero
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    most = np.zeros(len(n))
    np.maximum.at(most, o[at], times)
    same = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=len(n))
    return np.bincount(o[at], minlength=len(n)) / some, most / some, same / some


def measures(column: pa.Array) -> Iterator[np.ndarray]:
    """A matrix of measures for each run of texts, in order."""
    for first, end, data, offsets in slices(column):
        texts = end - first
        size = np.diff(offsets)
        owner = np.repeat(np.arange(texts), size)
        kinds = np.bincount(owner * _N_KINDS + _KINDS[data], minlength=texts * _N_KINDS).reshape(texts, _N_KINDS)
        hashes, starts, ends, where = words(data, offsets)
        n_words = np.diff(where)
        some = np.maximum(n_words, 1)
        length = (ends - starts).astype(float)
        of = np.repeat(np.arange(texts), n_words)
        mean = np.bincount(of, length, texts) / some
        spread = np.sqrt(np.maximum(0, np.bincount(of, length**2, texts) / some - mean**2))
        marks_end = np.bincount(of, (_KINDS[data[ends - 1]] >= 8) if len(ends) else None, texts) / some if len(of) else np.zeros(texts)
        upper_start = np.bincount(of, _KINDS[data[starts]] == 2, texts) / some if len(of) else np.zeros(texts)
        pairs = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) else hashes
        pair_where = np.minimum(where, len(pairs))
        lines, _, _, line_where = words(data, offsets, _NEWLINE)
        columns = [np.log1p(size), np.log1p(n_words), mean, spread, marks_end, upper_start, n_words / np.maximum(1, np.diff(line_where)), *_variety(hashes, where), *_variety(pairs, pair_where), *_variety(lines, line_where)]
        yield np.column_stack([*columns, kinds / np.maximum(1, size)[:, None]])


class Scorer:
    """Cuts of each measure at its quantiles and weights of the steps."""

    def __init__(self, cuts: np.ndarray, weights: np.ndarray, bias: float):
        self.cuts, self.weights, self.bias = cuts, weights, bias

    def steps(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :, None] > self.cuts[None]).reshape(len(x), -1).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j in range(x.shape[1]):
            out += np.concatenate(([0.0], np.cumsum(self.weights[j])))[np.searchsorted(self.cuts[j], x[:, j], "left")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _minimise(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int, seed: int, slack: float = 0.0, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk over mini-batches."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(pos.shape[1]), 0.0
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    batches = max(1, len(unl) // 512)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for epoch in range(epochs):
        for part_p, part_u in zip(np.array_split(rng.permutation(len(pos)), batches), np.array_split(rng.permutation(len(unl)), batches), strict=True):
            if not len(part_p):
                part_p = rng.integers(0, len(pos), 64)
            p, u = pos[part_p], unl[part_u]
            zp, zu = p @ w + b, u @ w + b
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gn_u, gn_p = sig(zu) / len(u), -prior * sig(zp) / len(p)
            if negative >= -slack:
                gp = prior * (sig(zp) - 1) / len(p) + gn_p
                gu = gn_u
            else:
                gp, gu = -gn_p, -gn_u
            grad = np.append(p.T @ gp + u.T @ gu + penalty * w, gp.sum() + gu.sum())
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            step = 0.02 * (0.98**epoch) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w -= step[:-1]
            b -= step[-1]
    return w, b


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = 60, seed: int = 3) -> Scorer:
    both = np.concatenate((positive, unlabelled))
    cuts = np.quantile(both, CUTS, axis=0).T if len(both) else np.zeros((positive.shape[1], len(CUTS)))
    # A measure that is mostly one value is also cut just there.
    cuts[:, 0] = np.minimum(cuts[:, 0], 0.0)
    cuts.sort(axis=1)
    scorer = Scorer(cuts, np.zeros(cuts.shape), 0.0)
    if not len(positive) or not len(unlabelled):
        return scorer
    p, u = scorer.steps(positive), scorer.steps(unlabelled)
    if prior is None:
        w, b = _minimise(p, u, 0.5, 10, seed)
        mean = lambda x: float((1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))).mean())
        prior = mean(u) / max(mean(p), 1e-9)
    prior = min(0.98, max(0.02, prior))
    w, b = _minimise(p, u, prior, epochs, seed)
    return Scorer(cuts, w.reshape(cuts.shape), b)


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.concatenate([np.zeros((0, 16 + _N_KINDS)), *measures(pa.array([(t or "").encode() for t in texts], pa.binary()))])


def _of(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Texts of a bounded sample of ids, which goes to the texts, so that these aren't shuffled."""
    return rows.join(F.broadcast(chosen), "id", "left_semi").select("id", "text")


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 1, folds: int = 3, sample_docs: int = 3000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Train on bounded samples of the folds that aren't held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    marks = marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("hi")).where("y = hi").drop("hi")
    if held_out is not None:
        rows, marks = (x.where(fold(F.col("id"), folds) != held_out) for x in (rows, marks))
    known = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = bounded_sample(marks.where("y = 1"), "y", "id", sample_docs)
    trusted = _of(rows, chosen).collect()
    web = bounded_sample(rows.withColumn("all", F.lit(1)), "all", "id", 2 * sample_docs).select("id", "text").collect()
    prior = known.get(1, 0) / (known.get(0, 0) + known.get(1, 0)) if known.get(0) and known.get(1) else None
    of = lambda got: _matrix([t for _, t in sorted((r["id"], r["text"] or "") for r in got)])
    return train(of(trusted), of(web), prior)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", keep: tuple | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score double`` and ``predicted int`` appended."""
    keep = tuple(docs.columns) if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast((scorer.cuts, scorer.weights, scorer.bias))
    rows, at = with_text(docs, keep, text_col)

    def run(batches):
        own = Scorer(*shared.value)
        for batch in batches:
            got = np.concatenate([np.zeros(0), *(own.scores(x) for x in measures(batch.column(at)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(got, pa.float64())], names=[*batch.schema.names[: len(keep)], "p_score"])

    schema = rows.drop("body").withColumn("p_score", F.lit(0.0)).schema
    for f in schema:
        f.nullable = True
    done = map_batches(rows, run, schema).select(*[F.col(f"in_{c}").alias(c) for c in keep], "p_score")
    return replace_columns(done, {"score": F.col("p_score"), "predicted": (F.col("p_score") >= 0.5).cast("int")}).drop("p_score")
