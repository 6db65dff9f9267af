"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are the embedding of the word (hashed to buckets) and the mean of those of its character trigrams
(of its UTF-8 bytes). The network reads windows of words that overlap and cover the whole text; the states of both
directions are pooled by attention, and a logistic unit scores the window. A text's score is that of its highest window.

Since a label holds for a text but not for each window of it, training goes as for bags of instances: after a first
round on windows drawn at random, a toxic text teaches by its highest window, a clean one by its highest and others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, mixed, string_bytes, string_hashes, with_columns
from .gru import Adam, back, step, summed_by


@dataclass(frozen=True)
class Settings:
    """max_toxic and max_clean bound the labelled rows that the network is fitted on, in so many passes over their windows at most.

    One in `validation` rows of each class is kept out of the updates; the network that ranks them best (share of
    toxic and clean pairs in order, softly) is taken, and training ends when none has been better for `patience` updates and three passes. A pass has about `updates` updates, of a batch between the two bounds.
    """

    window: int = 48
    stride: int = 40
    word_buckets: int = 65536
    least_texts: int = 4
    trigram_buckets: int = 4096
    dim: int = 12
    hidden: int = 8
    max_toxic: int = 1500
    max_clean: int = 3000
    passes: int = 24
    patience: int = 200
    validation: int = 6
    updates: int = 60
    rate: float = 0.01
    least_batch: int = 64
    batch: int = 128
    seed: int = 7


PUNCTUATION = ".,;:!?\"'()[]"
#: Windows that are scored side by side, and words whose trigrams are gathered at once.
LANES, WORDS = 1024, 20_000


class Words:
    """The distinct words of some texts as buckets and trigrams, and each text as indexes of them."""

    def __init__(self, texts: pa.Array | list[str], s: Settings):
        tokens = Tokens(texts, lower=True)
        self.sizes, self.index = tokens.sizes, tokens.index
        bare = pc.ascii_trim(tokens.words, PUNCTUATION)
        bare = pc.if_else(pc.equal(pc.binary_length(bare), 0), tokens.words, bare)
        self.bucket = (string_hashes(bare) % np.uint64(s.word_buckets)).astype(np.int64)
        data, ends = string_bytes(pc.binary_join_element_wise("\x02", bare, "\x03", ""))
        code = data.astype(np.uint64)
        code = mixed((code[:-2] * np.uint64(257) + code[1:-1]) * np.uint64(257) + code[2:]) if len(code) > 2 else code[:0]
        inside = np.ones(len(data), bool)
        inside[ends - 1] = inside[ends - 2] = False
        self.trigram = (code[inside[: len(code)]] % np.uint64(s.trigram_buckets)).astype(np.int64)
        self.trigrams = np.diff(ends, prepend=0) - 2
        self.first = np.cumsum(self.trigrams) - self.trigrams


def windows(sizes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of each window; an empty text has one window of no words."""
    n = 1 + np.maximum(0, -(-(sizes - s.window) // s.stride))
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    base = np.cumsum(sizes) - sizes
    start = base[text] + k * s.stride
    return text, start, np.minimum(s.window, base[text] + sizes[text] - start)


class Network:
    def __init__(self, s: Settings, params: dict[str, np.ndarray] | None = None):
        self.s = s
        r = np.random.default_rng(s.seed)
        h = s.hidden
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = params or {
            "word": draw(s.word_buckets, s.dim, scale=0.01),
            "known": np.ones(s.word_buckets, np.float32),
            "char": draw(s.trigram_buckets, s.dim, scale=0.3),
            "in": draw(2 * s.dim, 6 * h, scale=0.4),
            "in_b": np.zeros(6 * h, np.float32),
            "u0": draw(h, 3 * h, scale=0.4),
            "u1": draw(h, 3 * h, scale=0.4),
            "attend": draw(2 * h, 1, scale=0.3),
            "out": draw(2 * h, 1, scale=0.3),
            "out_b": np.full(1, -1.0, np.float32),
        }

    def inputs(self, w: Words) -> np.ndarray:
        """The inputs of each distinct word: its own embedding and its trigrams' mean."""
        if not len(w.bucket):
            return np.zeros((1, 2 * self.s.dim), np.float32)
        out = np.empty((len(w.bucket), 2 * self.s.dim), np.float32)
        out[:, : self.s.dim] = self.p["word"][w.bucket] * self.p["known"][w.bucket, None]
        for i in range(0, len(out), WORDS):
            j = min(len(out), i + WORDS)
            begin, end = int(w.first[i]), int(w.first[j - 1] + w.trigrams[j - 1])
            sums = np.add.reduceat(self.p["char"][w.trigram[begin:end]], w.first[i:j] - begin, axis=0)
            out[i:j, self.s.dim :] = sums / w.trigrams[i:j, None].astype(np.float32)
        return out

    def forward(self, projected: np.ndarray, index: np.ndarray, count: np.ndarray, keep: list | None = None):
        """Logits of windows given as indexes (lanes, window) and word counts.

        The forward direction reads from the left, the other one from each window's last word to its first.
        """
        h, lanes, width = self.s.hidden, len(index), int(count.max()) if len(count) else 0
        states = np.zeros((width, 2 * h, lanes), np.float32)
        live = np.arange(width)[:, None] < count
        full = live.all(axis=1)
        kept: tuple[list, list] = ([], [])
        for d in (0, 1):
            table = np.ascontiguousarray(projected[:, 3 * h * d : 3 * h * (d + 1)])
            state = np.zeros((h, lanes), np.float32)
            for t in range(width) if d == 0 else range(width - 1, -1, -1):
                x = np.ascontiguousarray(table.take(index[:, t], axis=0).T)
                new = step(x, state, self.p[f"u{d}"], kept[d] if keep is not None else None)
                state = new if full[t] else np.where(live[t], new, state)
                states[t, h * d : h * (d + 1)] = state
        e = np.where(live, (self.p["attend"].T @ states)[:, 0], -np.inf)
        e -= e.max(axis=0, initial=-1e30)
        a = np.exp(e)
        a /= np.maximum(a.sum(axis=0), 1e-30)
        pooled = np.einsum("tb,tkb->kb", a, states)
        logit = self.p["out"][:, 0] @ pooled + self.p["out_b"][0]
        if keep is not None:
            keep.extend((states, live, kept, a, pooled))
        return logit

    def gradients(self, w: Words, x: np.ndarray, index: np.ndarray, count: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted mean logistic loss over windows."""
        p, h = self.p, self.s.hidden
        keep: list = []
        projected = x @ p["in"] + p["in_b"]
        logit = self.forward(projected, index, count, keep)
        states, live, kept, a, pooled = keep
        width = len(states)
        g = {k: np.zeros_like(v) for k, v in p.items() if k != "known"}
        dl = ((1 / (1 + np.exp(-logit)) - target) * weight / max(weight.sum(), 1e-9)).astype(np.float32)
        g["out"] = (pooled @ dl)[:, None]
        g["out_b"] = np.array([dl.sum()], np.float32)
        dpooled = p["out"] * dl
        da = np.einsum("kb,tkb->tb", dpooled, states)
        de = a * (da - (a * da).sum(axis=0))
        g["attend"] = np.einsum("tb,tkb->k", de, states)[:, None]
        dstates = a[:, None] * dpooled + de[:, None] * p["attend"]
        dx = np.zeros((width, 6 * h, len(index)), np.float32)
        for d in (0, 1):
            dh = np.zeros((h, len(index)), np.float32)
            order = range(width) if d == 0 else range(width - 1, -1, -1)
            for t, k in zip(reversed(order), reversed(kept[d])):
                dh = dh + dstates[t, h * d : h * (d + 1)]
                on = live[t].astype(np.float32)
                dxt, before = back(k, dh * on, p[f"u{d}"], g[f"u{d}"])
                dx[t, 3 * h * d : 3 * h * (d + 1)] = dxt
                dh = before + dh * (1 - on)
        flat = index[:, :width].T[live]
        dp = summed_by(flat, dx.transpose(0, 2, 1)[live], len(x))
        g["in"], g["in_b"] = x.T @ dp, dp.sum(axis=0)
        used = np.flatnonzero(np.bincount(flat, minlength=len(x)))
        dinput = dp @ p["in"].T
        g["word"] = summed_by(w.bucket[used], dinput[used, : self.s.dim] * p["known"][w.bucket[used], None], self.s.word_buckets)
        share = dinput[:, self.s.dim :] / w.trigrams[:, None].astype(np.float32)
        which = np.repeat(np.arange(len(x)), w.trigrams)
        on = np.zeros(len(x), bool)
        on[used] = True
        on = on[which]
        g["char"] = summed_by(w.trigram[on], share[which[on]], self.s.trigram_buckets)
        return g

    def logits(self, w: Words, text: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        few = len(w.bucket) <= 10 * WORDS  # else each block of windows projects its own words
        projected = self.inputs(w) @ self.p["in"] + self.p["in_b"] if few else None
        out = np.empty(len(text), np.float32)
        offsets = np.arange(self.s.window)
        last = max(0, len(w.index) - 1)
        index = w.index if len(w.index) else np.zeros(1, np.int64)
        by_size = np.argsort(-count, kind="stable")  # windows of a like width side by side
        for i in range(0, len(text), LANES):
            lanes = by_size[i : i + LANES]
            block = index[np.minimum(start[lanes, None] + offsets, last)]
            if not few:
                words, block = local(w, block, count[lanes])
                projected = self.inputs(words) @ self.p["in"] + self.p["in_b"]
            out[lanes] = self.forward(projected, block, count[lanes])
        return out

    def scores(self, texts: pa.Array | list[str]) -> np.ndarray:
        """The probability of each text's highest window."""
        w = Words(texts, self.s)
        text, start, count = windows(w.sizes, self.s)
        best = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(best, text, self.logits(w, text, start, count))
        return 1 / (1 + np.exp(-best.astype(np.float64)))


def fit(texts: pa.Array | list[str], labels: list[int], s: Settings = Settings()) -> Network:
    """A network trained on labelled texts; with no texts of one class it scores that class's rate."""
    net = Network(s)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        for k in ("out", "attend"):
            net.p[k][:] = 0
        net.p["out_b"][:] = 4.0 if len(y) and y[0] else -4.0
        return net
    r = np.random.default_rng(s.seed)
    w = Words(texts, s)
    text, start, count = windows(w.sizes, s)
    # Words of a few texts only would tell these texts apart instead of the classes.
    texts_of = np.zeros(s.word_buckets, np.int64)
    for end, n in zip(np.cumsum(w.sizes).tolist(), w.sizes.tolist()):
        texts_of[np.unique(w.bucket[w.index[end - n : end]])] += 1
    net.p["known"] = (texts_of >= s.least_texts).astype(np.float32)
    adam = Adam({k: v for k, v in net.p.items() if k != "known"}, s.rate)
    offsets = np.arange(s.window)
    aside = np.zeros(len(y), bool)
    for label in (0, 1):
        own = r.permutation(np.flatnonzero(y == label))
        aside[own[: len(own) // s.validation]] = True
    best, kept, since, passes = -1.0, None, 0, 0
    for epoch in range(s.passes):
        chosen = np.zeros(len(text), bool)
        key = r.random(len(text))
        if epoch:
            order = np.lexsort((-logit, text))
            chosen[order[np.concatenate(([True], text[1:] != text[:-1]))]] = True
            key[y[text] == 1] = 2  # a toxic text's other windows may be clean
        order = np.lexsort((key, text))
        place = np.arange(len(text)) - np.repeat(np.cumsum(np.bincount(text)) - np.bincount(text), np.bincount(text))
        chosen[order[(place < 3) & (key[order] < 2)]] = True
        at = r.permutation(np.flatnonzero(chosen & ~aside[text]))
        size = int(np.clip(len(at) // s.updates, s.least_batch, s.batch))
        for i in range(0, len(at), size):
            b = at[i : i + size]
            index = w.index[np.minimum(start[b, None] + offsets, max(0, len(w.index) - 1))] if len(w.index) else np.zeros((len(b), s.window), np.int64)
            words, index = local(w, index, count[b])
            adam.update(net.gradients(words, net.inputs(words), index, count[b], y[text[b]], np.ones(len(b), np.float32)))
        logit = net.logits(w, text, start, count)
        if aside[y == 0].any() and aside[y == 1].any():
            top = np.full(len(y), -np.inf)
            np.maximum.at(top, text, logit)
            rank = float(np.mean(1 / (1 + np.exp(np.clip(top[aside & (y == 0)][:, None] - top[aside & (y == 1)], -30, 30)))))
            since, passes = since + -(-len(at) // size), passes + 1
            if rank > best:
                best, kept, since, passes = rank, {k: v.copy() for k, v in net.p.items()}, 0, 0
            elif since >= s.patience and passes >= 3:
                break
    if kept is not None:
        net.p = kept
    return net


def local(w: Words, index: np.ndarray, count: np.ndarray) -> tuple[Words, np.ndarray]:
    """The distinct words that a batch of windows has, and the windows as indexes of these."""
    used, inverse = np.unique(index, return_inverse=True)
    if not len(w.bucket):
        return w, index
    part = Words.__new__(Words)
    part.bucket, part.trigrams = w.bucket[used], w.trigrams[used]
    part.first = np.cumsum(part.trigrams) - part.trigrams
    part.trigram = w.trigram[np.repeat(w.first[used] - part.first, part.trigrams) + np.arange(int(part.trigrams.sum()))]
    return part, inverse.reshape(index.shape)


HELD_OUT = 5


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """text and toxic of the labelled rows to learn from: never a held-out one, max_toxic and max_clean at most.

    A document with several labels is toxic if one says so; null labels and null ids don't count. The rows are those with
    the smallest hashes of doc_id, so that they don't depend on the order of the tables. Only so many ids, a bounded
    number, are broadcast.
    """
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda toxic, n: one.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, s.max_toxic).unionByName(pick(0, s.max_clean))
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")


def trained(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Network:
    """A network fitted on the driver, on the bounded training_rows()."""
    rows = training_rows(documents, labels, s).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = rows.column("doc_id").to_numpy()
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]  # repeated ids teach once
    rows = rows.filter(pa.array(first))
    return fit(pc.fill_null(rows.column("text").combine_chunks(), ""), rows.column("toxic").to_pylist(), s)


def with_toxicity(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 where score is 0.5 or more) of each whole text.

    A null or empty text has one window of no words and so gets the network's prior. Equal texts get equal scores up to
    rounding, repeated rows stay, an empty table gives no rows, and columns of these names are replaced.
    """
    # Broadcasts are pickled by reference: only arrays go there, the classes go with the function.
    held, settings = df.sparkSession.sparkContext.broadcast(net.p), net.s

    def make():
        network = Network(settings, held.value)

        def columns(texts):
            score = network.scores(texts)
            return [score, (score >= 0.5).astype(np.int32)]

        return columns

    return with_columns(df, text, "score double, predicted int", make)
