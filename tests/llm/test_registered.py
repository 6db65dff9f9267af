"""Every registered query of the subpackage on the smallest tables, against independent code; and workers without the package."""

import base64
import cmath
import hashlib
import math
import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from claimlens.llm import gru, media, queries, toxicity
from claimlens.llm.common import table

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op1_media_fingerprints")}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        data = t.encode()
        payload = data + bytes(-len(data) % 64 or 64 * (not data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    short = min((i for i in texts if len(texts[i]) > 600), key=lambda i: len(texts[i]))
    data = texts[short].encode()
    payload = data + bytes(-len(data) % 64)
    assert list(zip(got[short].peak_times, got[short].peak_codes)) == plain_fingerprint(payload)


def plain_fingerprint(payload):
    """Pairs of peaks by a discrete Fourier transform in plain loops."""
    size, hop = media.FRAME, media.HOP
    strongest = []
    for a in range(0, max(1, len(payload)), hop):
        frame = [(payload[a + k] - 128 if a + k < len(payload) else 0) * (0.5 - 0.5 * math.cos(2 * math.pi * k / (size - 1))) for k in range(size)]
        power = [abs(sum(x * cmath.exp(-2j * math.pi * b * k / size) for k, x in enumerate(frame))) for b in range(size // 2 + 1)]
        mean, best = sum(power) / len(power), (0.0, 0)
        for low, high in zip(media.BANDS, media.BANDS[1:]):
            top = max(range(low, high), key=lambda b: power[b])
            if power[top] > mean and power[top] > best[0]:
                best = (power[top], top)
        strongest.append(best[1])
    return sorted((t, x << 16 | strongest[t + gap] << 4 | gap) for gap in range(1, media.FAN + 1) for t, x in enumerate(strongest[: len(strongest) - gap]) if x and strongest[t + gap])


def encoding(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


def test_op3_and_op9(spark, texts):
    own = encoding("byte_bpe_50k.tiktoken")
    ids = {i: own.encode_ordinary(t) for i, t in texts.items()}
    for r in rows(spark, "op3_byte_bpe"):
        mine = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(mine), hashlib.sha256(" ".join(map(str, mine)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    docs = {r.doc_id: (r.source, r.lang) for r in table(spark, SF, "documents").collect()}
    firsts = {}
    for i in sorted(texts):
        firsts.setdefault(texts[i], i)
    want = {}
    multi = encoding("byte_bpe_multi_50k.tiktoken")
    for t, i in firsts.items():
        for name, n in (("byte_bpe_50k", len(ids[i])), ("byte_bpe_multi_50k", len(multi.encode_ordinary(t)))):
            a, b = want.get((*docs[i], name), (0, 0))
            want[(*docs[i], name)] = (a + 1, b + n)
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rows(spark, "op9_token_rollups")} == want


def plain_logit(net, words):
    """The logit of one window, a word and a gate at a time."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, net.s.hidden
    w = toxicity.Words([" ".join(words)], net.s)
    sig = lambda x: 1 / (1 + math.exp(-x))
    xs = []
    for k in w.index.tolist():
        grams = w.trigram[w.first[k] : w.first[k] + w.trigrams[k]]
        own = p["word"][w.bucket[k]] * p["known"][w.bucket[k]]
        xs.append(np.concatenate((own, sum(p["char"][g] for g in grams) / len(grams))) @ p["in"] + p["in_b"])
    states = [[0.0] * (2 * h) for _ in xs]
    for d in (0, 1):
        s = np.zeros(h)
        for t in range(len(xs)) if d == 0 else range(len(xs) - 1, -1, -1):
            x, a = xs[t][3 * h * d : 3 * h * (d + 1)], s @ p[f"u{d}"]
            z, r = [sig(v) for v in x[:h] + a[:h]], [sig(v) for v in x[h : 2 * h] + a[h : 2 * h]]
            n = [math.tanh(x[2 * h + j] + r[j] * a[2 * h + j]) for j in range(h)]
            s = np.array([n[j] + z[j] * (s[j] - n[j]) for j in range(h)])
            states[t][h * d : h * (d + 1)] = s
    e = [math.exp(np.dot(p["attend"][:, 0], s)) for s in states]
    pooled = sum(np.array(s) * x for s, x in zip(states, e)) / sum(e) if e else np.zeros(2 * h)
    return float(p["out"][:, 0] @ pooled + p["out_b"][0])


def test_op4(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op4_toxicity")}
    assert got.keys() == texts.keys()
    net = toxicity.trained(table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels"))
    s = net.s
    for i in sorted(texts, key=lambda i: len(texts[i]))[:40]:
        words = texts[i].encode().split()
        words = [x.decode() for x in words]
        cuts = range(0, max(1, len(words) - s.window + s.stride), s.stride)
        score = 1 / (1 + math.exp(-max(plain_logit(net, words[a : a + s.window]) for a in cuts)))
        assert abs(got[i].score - score) < 1e-4 and got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_the_other_queries(spark, texts):
    assert sorted(r.doc_id for r in rows(spark, "op2_quality_rules")) == sorted(texts)
    joined = rows(spark, "op5_ngram_join")
    assert sorted(r.doc_id for r in joined) == sorted(texts) and all(r.class_id <= r.doc_id for r in joined)
    packed = rows(spark, "op6_best_fit_packing")
    assert {r.doc_id for r in packed} == set(texts) and all(r.bin_tokens <= 2048 for r in packed)
    total = {r.doc_id: 0 for r in packed}
    for r in packed:
        total[r.doc_id] += r.piece_tokens
    assert total == {i: len(t.encode().split()) for i, t in texts.items()}
    scored = rows(spark, "op7_lm_scores")
    assert sorted(r.doc_id for r in scored) == sorted(texts) and all(r.score < 0 for r in scored)
    assert len(rows(spark, "op8_warc")) == table(spark, SF, "pages").count()
    assert len(rows(spark, "op10_chat_format")) == table(spark, SF, "conversations").select("conv_id").distinct().count() + 1


def test_sigmoid_and_tanh():
    x = np.array([-200, -3, 0, 1e-4, 2, 200], np.float32)
    np.testing.assert_allclose(gru.sigmoid(x.copy()), 1 / (1 + np.exp(-x.astype(float))), atol=1e-7)
    np.testing.assert_allclose(gru.tanh(x.copy()), np.tanh(x), atol=2e-7)


WITHOUT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", False).getOrCreate()

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("claimlens") is not None])], names=["found"])

assert not spark.range(1).mapInArrow(importable, "found boolean").first().found
from claimlens.llm import queries
for name in {names!r}:
    assert queries.QUERIES[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_workers_need_not_have_the_package(tmp_path):
    code = WITHOUT.format(repo=REPO, sf=SF, names=["op3_byte_bpe", "op4_toxicity", "op5_ngram_join", "op7_lm_scores", "op8_warc", "op11_lexical_search", "op12_source_divergence", "op13_pii_spans"])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
