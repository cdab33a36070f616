"""Language identification by a linear-chain conditional random field over words.

Each word's emission scores come from hashed affix and n-gram features (the word with its
ends marked, all byte n-grams of two to four) and a lexicon feature (the whole word); states
are languages, with learned transitions. Forward-backward gives each word's distribution in
its context, which also labels code-switched text word by word; a document's language is
that with the largest expected share of its words.

Training reads at most ``sample_docs`` labelled documents per language (the first
``sample_chars`` characters of each; fewer documents each if there are over 64 languages), cut into sequences some of which join two languages.
Prediction covers every word of every text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no
labelled documents everything is ``und``; ties go to the first language in order; repeated
rows and other columns have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, replace_columns, with_text
from .sampling import bounded_sample, fold
from .textnp import mix64, slices, words

FEATURE_BITS = 17
SLICE = 4 << 20
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = False
_NOT_LETTER[128:] = False


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word and where each word's begin (lower-cased ASCII)."""
    length = ends - starts
    marked = length + 2
    at = np.cumsum(marked) - marked
    total = int(marked.sum())
    text = np.full(total + 4, 3, np.uint8)
    text[at] = 2
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    byte = data[np.repeat(starts, length) + inner]
    text[np.repeat(at + 1, length) + inner] = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    left = np.repeat(marked, marked) - (np.arange(total) - np.repeat(at, marked))  # bytes to the word's end
    word = np.repeat(np.arange(len(starts), dtype=np.int32), marked)
    wide = text.astype(np.uint64)
    codes, owners = [hashes >> np.uint64(64 - FEATURE_BITS)], [np.arange(len(starts), dtype=np.int32)]
    code = wide[:total]
    for n in (2, 3, 4):
        code = (code << np.uint64(8)) | wide[n - 1 : n - 1 + total]
        ok = left >= n
        codes.append(mix64(code[ok] + np.uint64(n << 40)) >> np.uint64(64 - FEATURE_BITS))
        owners.append(word[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    feature = np.concatenate(codes).astype(np.int64)[order]
    first = np.searchsorted(owner[order], np.arange(len(starts)))
    return feature, first


class WordChain:
    def __init__(self, langs: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.langs, self.weights, self.transitions = langs, weights, transitions

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros((0, len(self.langs)), np.float32)
        _, some, back = np.unique(hashes, return_index=True, return_inverse=True)
        out = np.empty((len(some), len(self.langs)), np.float32)
        # Words are scored in runs of bounded bytes.
        runs = np.searchsorted(np.cumsum(ends[some] - starts[some]), np.arange(0, int((ends[some] - starts[some]).sum()) + 1, 1 << 18))
        edges = np.unique(np.concatenate((runs, [0, len(some)])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            feature, first = _features(data, starts[some[a:b]], ends[some[a:b]], hashes[some[a:b]])
            count = np.diff(np.append(first, len(feature))).astype(np.float32)
            out[a:b] = np.add.reduceat(self.weights[feature], first, axis=0) / np.sqrt(count)[:, None]
        return out[back.ravel()]

    def marginals(self, emissions: np.ndarray, where: np.ndarray) -> np.ndarray:
        return forward_backward(emissions, where, self.transitions)[0]


def forward_backward(emissions: np.ndarray, where: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Each word's state distribution; with ``pairs`` also the expected number of each transition."""
    k = emissions.shape[1]
    move = np.exp(transitions)
    local = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64) if len(emissions) else emissions.astype(np.float64)
    length = np.diff(where)
    order = np.argsort(-length, kind="stable")
    begin, length = where[:-1][order], length[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left") if longest else []
    alpha = np.empty((len(emissions), k))
    state = None
    for t in range(longest):
        m = active[t]
        at = begin[:m] + t
        state = local[at] if t == 0 else (state[:m] @ move) * local[at]
        state /= state.sum(axis=1, keepdims=True)
        alpha[at] = state
    counts = np.zeros((k, k))
    beta = np.ones((len(length), k))
    for t in range(longest - 2, -1, -1):
        m = active[t + 1]
        ahead = local[begin[:m] + t + 1] * beta[:m]
        at = begin[:m] + t
        if pairs:
            joint = alpha[at][:, :, None] * move[None] * ahead[:, None, :]
            counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        new = ahead @ move.T
        new /= new.sum(axis=1, keepdims=True)
        beta[:m] = new
        alpha[at] *= new
    alpha /= np.maximum(alpha.sum(axis=1, keepdims=True), 1e-300)
    return alpha, counts


def train_chain(samples: list[tuple[str, str]], epochs: int = 8, steps: int = 24, length: int = 60, seed: int = 7, most_pieces: int = 1200) -> WordChain:
    """Fit emissions and transitions by gradient ascent on the likelihood of labelled sequences.

    At most ``most_pieces`` pieces of ``length // 2`` words of each language are taken, from anywhere in its texts.
    """
    langs = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    k = len(langs)
    bodies = [t.encode() for _, t in samples]
    label = np.array([langs.index(lang) for lang, _ in samples])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
    hashes, starts, ends, where = words(data, offsets, _NOT_LETTER)
    if not len(hashes):
        return WordChain([], np.zeros((1 << FEATURE_BITS, 0), np.float32), np.zeros((0, 0)))
    pieces = []
    for i in range(len(samples)):
        a, b = int(where[i]), int(where[i + 1])
        half = length // 2
        pieces += [(s, min(s + half, b), label[i]) for s in range(a, b, half)]
    by_lang = [[p for p in pieces if p[2] == j] for j in range(k)]
    chosen = [x[i] for x in by_lang if x for i in rng.permutation(len(x))[:most_pieces]]
    chosen = [chosen[i] for i in rng.permutation(len(chosen))]
    # A sequence is two pieces: of one language or, as often as chance has it, of two.
    token = np.concatenate([np.arange(a, b) for a, b, _ in chosen])
    gold = np.concatenate([np.full(b - a, j) for a, b, j in chosen])
    sizes = np.array([b - a for a, b, _ in chosen])
    if len(sizes) % 2:
        sizes = np.append(sizes, 0)
    seq = np.concatenate(([0], np.cumsum(sizes.reshape(-1, 2).sum(axis=1))))
    _, some, back = np.unique(hashes[token], return_index=True, return_inverse=True)
    back = back.ravel()
    some = token[some]
    feature, first = _features(data, starts[some], ends[some], hashes[some])
    count = np.diff(np.append(first, len(feature)))
    scale = 1 / np.sqrt(count)
    owner = np.repeat(np.arange(len(some)), count)
    weights, moves = np.zeros((1 << FEATURE_BITS, k)), np.zeros((k, k))
    seen_w, seen_m = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    inside = np.ones(len(token), bool)
    inside[seq[1:-1][seq[1:-1] < len(token)]] = False
    inside[0] = False
    pairs_gold = np.zeros((k, k))
    np.add.at(pairs_gold, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)
    for _ in range(epochs * 3):
        scores = np.add.reduceat(weights[feature], first, axis=0) * scale[:, None]
        marginal, pairs = forward_backward(scores[back], seq, moves, pairs=True)
        grad = -marginal
        grad[np.arange(len(gold)), gold] += 1
        by_word = np.stack([np.bincount(back, grad[:, j], len(some)) for j in range(k)], axis=1) * scale[:, None]
        step = np.stack([np.bincount(feature, by_word[owner, j], 1 << FEATURE_BITS) for j in range(k)], axis=1) - 1e-2 * weights
        seen_w += step**2
        weights += 0.3 * step / np.sqrt(seen_w)
        step = pairs_gold - pairs - 1e-2 * moves
        seen_m += step**2
        moves += 0.1 * step / np.sqrt(seen_m)
    return WordChain(langs, weights.astype(np.float32), moves)


def _letters(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def label_texts(model: WordChain, column: pa.Array) -> Iterator[tuple[str, float]]:
    """Language and score of each text in order."""
    for first, end, data, offsets in slices(column, SLICE):
        hashes, starts, ends, where = words(data, offsets, _NOT_LETTER)
        share = np.zeros((end - first, len(model.langs)))
        if len(hashes) and model.langs:
            marginal = model.marginals(model.emissions(data, starts, ends, hashes), where)
            full = np.flatnonzero(np.diff(where))
            share[full] = np.add.reduceat(marginal, where[:-1][full], axis=0) / np.diff(where)[full][:, None]
        ascii_ = np.add.reduceat(np.concatenate((((data | 32) >= 97) & ((data | 32) <= 122), [False])), np.minimum(offsets[:-1], len(data)), dtype=np.int64) if len(data) else np.zeros(end - first, np.int64)
        ascii_[np.diff(offsets) == 0] = 0
        for i in range(end - first):
            if not model.langs or not (ascii_[i] or _letters(data[offsets[i] : offsets[i + 1]].tobytes())) or where[i] == where[i + 1]:
                yield "und", 0.0
            else:
                best = int(share[i].argmax())
                yield model.langs[best], float(min(1.0, max(0.0, share[i][best])))


def label_words(model: WordChain, text: str | None) -> list[tuple[str, str, float]]:
    """Each word of a text (lower-cased A-Z) with its language in context and that one's share, as for code-switched text."""
    body = (text or "").encode()
    data = np.frombuffer(body, np.uint8)
    hashes, starts, ends, where = words(data, np.array([0, len(body)]), _NOT_LETTER)
    if not len(hashes) or not model.langs:
        return []
    marginal = model.marginals(model.emissions(data, starts, ends, hashes), where)
    best = marginal.argmax(axis=1)
    return [(body[a:b].lower().decode("utf-8", "replace"), model.langs[k], float(p[k])) for a, b, k, p in zip(starts, ends, best, marginal, strict=True)]


def fit(docs: DataFrame, held_out: int | None = 2, folds: int = 4, sample_docs: int = 300, sample_chars: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> WordChain:
    """Train on a bounded sample of labelled rows outside the held-out fold."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null and id is not null")
    if held_out is not None:
        rows = rows.where(fold(F.col("id"), folds) != held_out)
    rows = bounded_sample(rows, "lang", "id", sample_docs).select("id", "lang", F.substring("text", 1, sample_chars).alias("text"))
    got = sorted((r["lang"], r["id"], r["text"]) for r in rows.collect())
    return train_chain([(lang, text) for lang, _, text in got])


def _labelled(docs: DataFrame, model: WordChain, text_col: str, keep: tuple) -> DataFrame:
    """``in_NAME`` of the columns ``keep``, ``p_lang`` and ``p_score``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.transitions))
    rows, at = with_text(docs, keep, text_col)

    def label(batches):
        chain = WordChain(*shared.value)
        for batch in batches:
            got = list(label_texts(chain, batch.column(at)))
            columns = [*batch.columns[: len(keep)], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: len(keep)], "p_lang", "p_score"])

    schema = rows.drop("body").withColumn("p_lang", F.lit("")).withColumn("p_score", F.lit(0.0)).schema
    for f in schema:
        f.nullable = True
    return map_batches(rows, label, schema)


def identify(docs: DataFrame, model: WordChain, text_col: str = "text", keep: tuple | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred`` and ``score`` appended."""
    keep = tuple(docs.columns) if keep is None else keep
    done = _labelled(docs, model, text_col, keep).select(*[F.col(f"`in_{c}`").alias(c) for c in keep], "p_lang", "p_score")
    return replace_columns(done, {"lang_pred": F.col("p_lang"), "score": F.col("p_score")}).drop("p_lang", "p_score")


def keep_identified(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``, with their columns."""
    done = _labelled(docs, fit(docs, held_out=None), "text", tuple(docs.columns))
    return done.where((F.col("p_lang") != "und") & (F.col("p_score") >= min_score)).select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])
