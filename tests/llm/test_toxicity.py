"""The toxicity network: gradients, held-out accuracy, whole texts and odd rows."""

import random
import zlib

import numpy as np

from claimlens.llm import toxicity as tx


def made(n, seed):
    """Texts of invented words; every fourth has two or three words of abuse in one place."""
    r = random.Random(seed)
    syllables = ["an", "the", "re", "on", "ti", "sh", "ou", "en", "st"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(20, 160))]
        if i % 4 == 0:
            at = r.randrange(len(words))
            words[at:at] = [r.choice(["idiot", "scum.", "moron"]) for _ in range(r.randrange(2, 4))]
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_gradients_are_those_of_the_loss():
    s = tx.Settings(window=6, stride=4, word_buckets=11, trigram_buckets=13, dim=3, hidden=3)
    net = tx.Network(s)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w = tx.Words(["the cat sat on a mat you idiot go", "hi there", "", "one two three four five six seven eight nine ten"], s)
    text, start, count = tx.windows(w.sizes, s)
    index = w.index[np.minimum(start[:, None] + np.arange(6), len(w.index) - 1)]
    y = (np.arange(len(text)) % 2).astype(float)

    def loss():
        out = net.forward(net.inputs(w) @ net.p["in"] + net.p["in_b"], index, count).astype(np.float64)
        return np.mean(np.logaddexp(0, out) - y * out)

    grads = net.gradients(w, net.inputs(w), index, count, y, np.ones(len(text)))
    for k, g in grads.items():
        flat, values = g.reshape(-1), net.p[k].reshape(-1)
        j = int(np.argmax(abs(flat)))
        old = values[j]
        values[j] = old + 1e-3
        up = loss()
        values[j] = old - 1e-3
        down = loss()
        values[j] = old
        assert abs(flat[j] - (up - down) / 2e-3) < 1e-4, k


def test_windows_overlap_and_cover_whole_texts():
    s = tx.Settings(window=6, stride=4)
    sizes = np.array([0, 1, 6, 7, 23])
    text, start, count = tx.windows(sizes, s)
    base = np.cumsum(sizes) - sizes
    for k, n in enumerate(sizes):
        mine = text == k
        seen = {int(p) for a, c in zip(start[mine], count[mine]) for p in range(a, a + c)}
        assert seen == set(range(base[k], base[k] + n))
        assert ((start[mine][1:] - start[mine][:-1]) < s.window).all()


def test_held_out_accuracy():
    texts, labels = made(500, 1)
    net = tx.fit(texts, labels)
    more, truth = made(200, 2)
    right = (net.scores(more) >= 0.5) == np.array(truth, bool)
    assert right.mean() > 0.93
    hidden = " ".join(["anon reti"] * 3000) + " you idiot scum moron " + " ".join(["anon reti"] * 3000)
    assert net.scores([hidden])[0] > net.scores(["anon reti " * 6000])[0]


def test_one_class_or_no_rows():
    assert (tx.fit([], []).scores(["x", ""]) < 0.5).all()
    assert (tx.fit(["a", "b"], [1, 1]).scores(["x"]) > 0.5).all()


def test_query_rows(spark):
    texts, labels = made(60, 3)
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(60, None, "c"), (61, "", "c"), (62, "x" * 50000, "c"), (62, "x" * 50000, "c"), (None, "a", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*enumerate(labels), (0, None), (None, 1), (999, 1), (1, 1)], "doc_id long, toxic int")
    taught = {r.doc_id: r.toxic for r in tx.training_rows(docs, marks).collect()}
    assert taught == {i: max(y, int(i == 1)) for i, y in enumerate(labels) if zlib.crc32(str(i).encode()) % 5}
    net = tx.trained(docs, marks)
    got = tx.with_toxicity(docs, net)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert tx.with_toxicity(docs.limit(0), net).count() == 0
    few = tx.Settings(max_toxic=3, max_clean=4)
    assert tx.training_rows(docs, marks, few).count() == 7


def test_held_out_labels():
    """On the 825 held-out labels of the larger table at least what the first version caught (.80) and its order (AUC .95)."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    texts = dict(zip(docs["doc_id"], docs["text"]))
    labels = pq.read_table(f"{sf}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist()
    parts = [[(texts[x["doc_id"]] or "", x["toxic"]) for x in labels if (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) == out] for out in (False, True)]
    train, held = ((pa.array([t for t, _ in p], pa.string()), np.array([y for _, y in p])) for p in parts)
    scores = tx.fit(train[0], train[1].tolist()).scores(held[0])
    toxic, clean = scores[held[1] == 1], scores[held[1] == 0]
    assert np.mean(toxic >= 0.5) >= 0.80 and np.mean(clean >= 0.5) <= 0.02
    assert np.mean(toxic[:, None] > clean) >= 0.95
