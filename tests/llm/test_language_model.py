"""The language model: gradients, likelihoods by plain loops, base scores by hand, layouts of the input, odd rows."""

import dataclasses
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimlens.llm import language_model as lm
from claimlens.llm.common import Tokens

SMALL = lm.Settings(classes=3, class_step=2, known=14, endings=5, dim=3, hidden=4, window=5, lanes=4)


def small_vocabulary():
    words = [f"w{i}" for i in range(14)]
    counts = np.arange(14, 0, -1).astype(np.int64) * 3
    return lm.Vocabulary(pa.array(words), counts, 9, int(counts.sum()) + 9 + 40, 14 + 1 + 11)


def ids_of(texts, v, s=SMALL):
    t = Tokens(texts, lower=True)
    stream = lm.coded(t, v, s)[1].astype(np.uint16)[t.index]
    return np.split(stream, t.ends()[:-1])


def weights(seed=4, scale=0.5):
    flat = lm.start_weights(small_vocabulary(), SMALL)
    return (flat + np.random.default_rng(seed).standard_normal(len(flat)).astype(np.float32) * scale).astype(np.float32)


def plain_likelihood(flat, ids, s):
    """The log likelihood of one document, a word and a class at a time."""
    p = {k: w.astype(np.float64) for k, w in lm.views(flat, s).items()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    h, total, before = [0.0] * s.hidden, 0.0, lm.END
    starts = s.class_starts().tolist()
    for word in [*ids.tolist(), lm.END]:
        x = p["embed"][before] @ p["in"] + p["in_b"]
        a = [sum(h[i] * p["u"][i][j] for i in range(s.hidden)) for j in range(3 * s.hidden)]
        new = []
        for j in range(s.hidden):
            z, r = sig(x[j] + a[j]), sig(x[s.hidden + j] + a[s.hidden + j])
            n = math.tanh(x[2 * s.hidden + j] + r * a[2 * s.hidden + j])
            new.append(n + z * (h[j] - n))
        h, before = new, word
        target = word if word < s.outputs else lm.TAIL
        c = next(k for k in range(s.classes) if starts[k] <= target < starts[k + 1])
        over_classes = [math.exp(p["class"][k] @ h + p["class_b"][k]) for k in range(s.classes)]
        over_words = [math.exp(p["word"][o] @ h + p["word_b"][o]) for o in range(starts[c], starts[c + 1])]
        total += math.log(over_classes[c] / sum(over_classes)) + math.log(over_words[target - starts[c]] / sum(over_words))
    return total


def test_likelihoods_by_plain_loops():
    v, flat = small_vocabulary(), weights()
    docs = ids_of(["w1 w2 w3 zz w1 w9 w13 other w0 w0 w4 w1 w2", "", "w5", "w2 w2 " * 9], v)
    got = lm.score(flat, docs, SMALL)
    np.testing.assert_allclose(got, [plain_likelihood(flat, d, SMALL) for d in docs], rtol=1e-5)
    np.testing.assert_allclose(got, lm.score(flat, docs, dataclasses.replace(SMALL, window=100)), rtol=1e-5)
    for d, x in zip(docs, got):
        np.testing.assert_allclose(lm.score(flat, [d], SMALL), [x], rtol=1e-5)


def test_gradients_through_time():
    """Of a whole window with a document's beginning inside it, for every parameter, against differences."""
    flat = weights().astype(np.float64)
    r = np.random.default_rng(0)
    xs, ys = r.integers(0, SMALL.outputs + SMALL.endings, (6, 3)), r.integers(0, SMALL.outputs, (6, 3))
    ys[4:, 2] = -1
    starts = np.zeros((6, 3), bool)
    starts[0, 0] = starts[3, 1] = True
    state = r.standard_normal((SMALL.hidden, 3)) * 0.3
    grad = np.zeros_like(flat)

    def loss():
        return lm.gradients(lm.views(flat, SMALL), xs, ys, starts, state, SMALL, lm.views(np.zeros_like(flat), SMALL))[2]

    _, n, _ = lm.gradients(lm.views(flat, SMALL), xs, ys, starts, state, SMALL, lm.views(grad, SMALL))
    assert n == 16
    for j in range(len(flat)):
        old = flat[j]
        flat[j] = old + 1e-5
        up = loss()
        flat[j] = old - 1e-5
        down = loss()
        flat[j] = old
        assert abs(grad[j] - (up - down) / 2e-5) < 1e-4 * max(1, abs(grad[j])), j


def test_probabilities_add_up_to_one():
    p = lm.views(weights(), SMALL)
    hs = np.repeat(np.random.default_rng(1).standard_normal((4, 1)).astype(np.float32), SMALL.outputs, axis=1)
    logp, _ = lm.output_scores(p, hs, np.arange(SMALL.outputs), SMALL)
    assert abs(np.exp(logp).sum() - 1) < 1e-5


def test_lanes_hold_each_word_once():
    s = dataclasses.replace(SMALL, lanes=3, piece=4)
    docs = [np.array([10, 11, 3, 4, 5, 6, 7], np.uint16), np.zeros(0, np.uint16), np.array([8, 13], np.uint16), np.array([2, 3, 4], np.uint16)]
    x, y, new = lm.laid_out(docs, s)
    assert (y >= 0).sum() == sum(len(d) + 1 for d in docs)
    assert Counter(y[y >= 0].tolist()) == Counter(o for d in docs for o in [*lm.outputs_of(d.astype(int), s).tolist(), lm.END])
    # Within a piece the input is the word before; a document's second piece goes on from the first one's last word.
    assert sorted(x[new].tolist()) == [lm.END, lm.END, lm.END, lm.END, 4]
    assert ((y[:-1] >= 0) | (y[1:] < 0)).all()


def test_training_lowers_the_loss():
    v = small_vocabulary()
    s = dataclasses.replace(SMALL, rate=0.02)
    flat = lm.start_weights(v, s)
    docs = ids_of(["w0 w1 w2 w3 " * 60] * 8, v, s)
    before = lm.score(flat, docs, s).sum()
    for _ in range(6):
        assert lm.train(flat, docs, s) == 8 * 241
    assert lm.score(flat, docs, s).sum() > 0.6 * before


def corpus():
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["The", "cat", "sat", "on", "a", "mat", f"x{r.randrange(60)}"]) for _ in range(r.randrange(0, 50))), "clash") for i in range(150)]
    return rows + [(150, None, "c"), (151, "", "c"), (152, "Zq\x0bé É", "c"), (153, "zz " * 9000, "c"), (153, "zz " * 9000, "c"), (None, "the cat", "c"), (None, None, "c")]


def test_query_against_counts_by_hand(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    s = dataclasses.replace(SMALL, known=20)
    got = lm.with_scores(df.repartition(3), s=s).collect()
    assert len(got) == len(rows)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["<end>"]
    tokens = {i: words(t) for i, t, _ in rows if i is not None}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in [*tokens, None]}
    counts = Counter(w for i, t, _ in rows if not held[i] for w in words(t))
    n, v = sum(counts.values()), len(counts)
    assert sorted(x.n_tokens for x in got if x.doc_id is None) == [1, 3]
    for x in (x for x in got if x.doc_id is not None):
        mine = tokens[x.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine)
        assert (x.held_out, x.n_tokens, x.train_tokens) == (held[x.doc_id], len(mine), n)
        assert x.n_known == sum(counts[w] > 0 for w in mine)
        assert abs(x.base_score - base) < 1e-6 * max(1, abs(base))
        assert math.isfinite(x.score) and x.score < 0


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, n_tokens string").where("doc_id is not null")
    s = dataclasses.replace(SMALL, known=20, shard_tokens=3000, rounds=(0.5, 0.5))
    runs = [sorted((x.doc_id, x.score) for x in lm.with_scores(df.repartition(n, "doc_id"), s=s).collect()) for n in (1, 3, 8)]
    for other in runs[1:]:
        assert [i for i, _ in other] == [i for i, _ in runs[0]]
        np.testing.assert_allclose([x for _, x in other], [x for _, x in runs[0]], rtol=1e-6)


@pytest.mark.parametrize("rows", [[], [(0, "held out only")]])
def test_no_training_documents(spark, rows):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame([(ids[i], t) for i, t in rows], "doc_id long, text string")
    got = lm.with_scores(df, s=SMALL).collect()
    assert [(x.n_known, x.train_tokens, x.n_tokens) for x in got] == [(0, 0, 4)] * len(rows)
