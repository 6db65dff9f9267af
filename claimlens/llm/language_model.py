"""Language-model scores: a gated recurrent network with a class-factored softmax, in numpy.

The head of the vocabulary, its most frequent words, is predicted word by word: first the class of the next word, then
the word in its class. Classes of frequent words are small, so that most words are told apart among few. All other
words share one output, the tail, and are told apart by their smoothed counts, so that the probabilities of all words
and of an unknown one add up to one. A tail word's input is chosen by its last bytes.

The corpus is tokenised twice: for counts, and then into ids, which are stored with each document's base score. The
training documents are dealt to rounds, and those of a round to shards of a number of tokens, by hashes of their texts
and ids, so that neither files nor partitions matter. In a round, each shard goes on from the last weights
(truncated backpropagation: gradients end at the windows' edges, the state goes on to the document's end), and the new
weights are the mean over the shards, summed as integers so that the order of the sums doesn't matter either. Each
training document is in one round. The scores carry the state from window to window through whole documents.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tokens, mixed, scratch, stored, string_bytes, text_batches
from .gru import Adam, back, step, summed_by


@dataclass(frozen=True)
class Settings:
    """known: most frequent words whose counts every task gets (a bound).

    Class k of the softmax has class_step * (k + 1) outputs. rounds: shares of the training documents, in order; they
    add up to 1. shard_tokens: training tokens of a shard, on average. piece: a longer document is trained on in pieces of
    so many tokens, each with a state of its own (it is scored as a whole).
    """

    classes: int = 40
    class_step: int = 5
    known: int = 65536
    endings: int = 256
    dim: int = 16
    hidden: int = 20
    window: int = 32
    lanes: int = 256
    rate: float = 0.014
    rounds: tuple[float, ...] = (0.1, 0.15, 0.15, 0.2, 0.2, 0.2)
    shard_tokens: int = 500_000
    piece: int = 1024
    chunk_bytes: int = 12_000_000
    seed: int = 3

    @property
    def outputs(self) -> int:
        return self.class_step * self.classes * (self.classes + 1) // 2

    def class_starts(self) -> np.ndarray:
        """The first output of each class, and the number of outputs."""
        k = np.arange(self.classes + 1)
        return self.class_step * k * (k + 1) // 2


#: Output ids: the end of a document, and any word that isn't in the head. Head words follow by falling count.
END, TAIL, FIRST = 0, 1, 2
#: Columns that the softmax works on at once, so that its arrays stay in the cache.
COLUMNS = 1024
#: Documents' tokens that are scored before the softmax is applied to their states.
FLUSH = 32768
LN10 = float(np.log(10.0))
HELD_OUT = 10


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 10; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


@dataclass
class Vocabulary:
    """words and counts of the most frequent words, by falling count, and the corpus's totals."""

    words: pa.Array
    counts: np.ndarray
    ends: int
    total: int
    distinct: int

    @property
    def mass(self) -> float:
        """The denominator of the base: every count and one for an unknown word, each with 0.1 added."""
        return self.total + 0.1 * (self.distinct + 1)

    def tail_mass(self, s: Settings) -> float:
        head = self.counts[: s.outputs - FIRST]
        return max(self.mass - float((head + 0.1).sum()) - (self.ends + 0.1), 0.1)


def gathered_counts(docs: DataFrame, s: Settings, text: str) -> DataFrame:
    """word and n over all training documents; the empty word stands for the ends."""

    def run(batches):
        names, waiting, rows = ["word", "n"], [], 0

        def merged():
            return pa.concat_tables(waiting).group_by("word").aggregate([("n", "sum")]).rename_columns(names)

        for _, texts in text_batches(batches, text, s.chunk_bytes):
            t = Tokens(texts, lower=True)
            waiting.append(pa.table([pa.array([""]), pa.array([len(texts)], pa.int64())], names=names))
            waiting.append(pa.table([t.words, pa.array(np.bincount(t.index, minlength=len(t.words)))], names=names))
            rows += len(t.words)
            if rows > 1_500_000:
                waiting = [merged()]
                rows = waiting[0].num_rows
                if rows > 1_000_000:
                    yield from waiting[0].to_batches()
                    waiting, rows = [], 0
        if waiting:
            yield from (merged() if len(waiting) > 2 else pa.concat_tables(waiting)).to_batches()

    rows = docs.where(~held_out()).select(text).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    """Totals, and at most s.known words: those above a count that a histogram of counts in fine steps gives."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.where("word != ''")
    level = F.floor(F.log2(F.col("n").cast("double")) * 32)
    steps = sorted(((r.level, r.m) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect()), reverse=True)
    cut, held = None, 0
    for at, m in steps:
        if held + m > s.known:
            break
        cut, held = at, held + m
    rows = words.where(level >= cut).collect() if cut is not None else []
    rows.sort(key=lambda r: (-r.n, r.word))
    ends = counts.where("word = ''").first()
    return Vocabulary(pa.array([r.word for r in rows], pa.string()), np.array([r.n for r in rows], np.int64), ends.n if ends else 0, total, distinct)


def shapes(s: Settings) -> dict[str, tuple[int, ...]]:
    h = s.hidden
    return {
        "embed": (s.outputs + s.endings, s.dim),
        "in": (s.dim, 3 * h),
        "in_b": (3 * h,),
        "u": (h, 3 * h),
        "class": (s.classes, h),
        "class_b": (s.classes,),
        "word": (s.outputs, h),
        "word_b": (s.outputs,),
    }


def views(flat: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """The parameters as parts of one vector."""
    out, at = {}, 0
    for name, shape in shapes(s).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start_weights(v: Vocabulary, s: Settings) -> np.ndarray:
    """Small random weights; the softmax biases are the logarithms of the counts, so that the start is the base."""
    flat = np.zeros(sum(int(np.prod(x)) for x in shapes(s).values()), np.float32)
    p, r = views(flat, s), np.random.default_rng(s.seed)
    for name, scale in (("embed", 0.3), ("in", 0.3), ("u", 0.3), ("class", 0.02), ("word", 0.02)):
        p[name][:] = r.standard_normal(p[name].shape) * scale
    mass = np.full(s.outputs, 1e-9)
    head = v.counts[: s.outputs - FIRST] + 0.1
    mass[END], mass[TAIL] = v.ends + 0.1, v.tail_mass(s)
    mass[FIRST : FIRST + len(head)] = head
    starts = s.class_starts()
    by_class = np.add.reduceat(mass, starts[:-1])
    p["class_b"][:] = np.log(by_class / mass.sum())
    p["word_b"][:] = np.log(mass / np.repeat(by_class, np.diff(starts)))
    return flat


def coded(t: Tokens, v: Vocabulary, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct word: its place among the known words (-1: none) and its input id, that is its output id or, of a word
    in the tail, one that its last bytes choose."""
    place = pc.index_in(t.words, value_set=v.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(v.words) else np.full(len(t.words), -1, np.int64)
    head = (place >= 0) & (place < s.outputs - FIRST)
    data, ends = string_bytes(t.words)
    code = np.zeros(len(place), np.uint64)
    begin = ends - np.diff(ends, prepend=0)
    for k in (1, 2, 3):
        at = ends - k
        code = code * np.uint64(257) + np.where(at >= begin, data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) if len(data) else code
    ending = (mixed(code) % np.uint64(s.endings)).astype(np.int64)
    return place, np.where(head, place + FIRST, s.outputs + ending)


def outputs_of(ids: np.ndarray, s: Settings) -> np.ndarray:
    """The output ids that belong to input ids."""
    return np.where(ids < s.outputs, ids, TAIL)


def _log_softmax_at(logits: np.ndarray, target: np.ndarray, normalise: bool) -> np.ndarray:
    """Log probabilities of the targets of columns; logits become the softmax if that is wanted."""
    logits -= logits.max(axis=0)
    picked = logits[target, np.arange(len(target))]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    if normalise:
        logits /= total
    return picked - np.log(total)


def output_scores(p: dict, hs: np.ndarray, target: np.ndarray, s: Settings, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each target, given states as columns; with grads, adds the gradients of minus their sum and returns the states' too."""
    starts = s.class_starts()
    order = np.argsort(target.astype(np.uint16) if s.outputs <= 1 << 16 else target, kind="stable")
    hs, target = np.take(hs, order, axis=1), target[order]
    cls = np.repeat(np.arange(s.classes), np.diff(starts))[target]
    within = target - starts[cls]
    learning = grads is not None
    logp = np.empty(len(order), hs.dtype)
    dh = np.empty_like(hs) if learning else None
    for a in range(0, len(order), COLUMNS):
        h, c = hs[:, a : a + COLUMNS], cls[a : a + COLUMNS]
        logits = p["class"] @ h
        logits += p["class_b"][:, None]
        logp[a : a + COLUMNS] = _log_softmax_at(logits, c, learning)
        if learning:
            logits[c, np.arange(len(c))] -= 1
            grads["class"] += logits @ h.T
            grads["class_b"] += logits.sum(axis=1)
            dh[:, a : a + COLUMNS] = p["class"].T @ logits
    edges = np.searchsorted(cls, np.arange(s.classes + 1)).tolist()
    for c, (lo, hi) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
        weights, bias = p["word"][lo:hi], p["word_b"][lo:hi, None]
        for a in range(edges[c], edges[c + 1], COLUMNS):
            b = min(edges[c + 1], a + COLUMNS)
            h, w = hs[:, a:b], within[a:b]
            logits = weights @ h
            logits += bias
            logp[a:b] += _log_softmax_at(logits, w, learning)
            if learning:
                logits[w, np.arange(b - a)] -= 1
                grads["word"][lo:hi] += logits @ h.T
                grads["word_b"][lo:hi] += logits.sum(axis=1)
                dh[:, a:b] += weights.T @ logits
    back_order = np.empty_like(order)
    back_order[order] = np.arange(len(order))
    return logp[back_order], np.take(dh, back_order, axis=1) if learning else None


def laid_out(docs: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (input ids of their words) in lanes: inputs, outputs (-1: nothing) and where a piece begins, (time, lanes).

    Pieces are dealt longest first to the shortest lane, and follow each other in a lane in a random order. Lanes come by
    falling length, so that those still at work are the first ones.
    """
    pieces = [(k, a) for k, d in enumerate(docs) for a in range(0, len(d) + 1, s.piece)]
    sizes = [min(s.piece, len(docs[k]) + 1 - a) for k, a in pieces]
    parts: list[list[int]] = [[] for _ in range(min(s.lanes, len(pieces)))]
    heap = [(0, i) for i in range(len(parts))]
    for k in sorted(range(len(pieces)), key=lambda k: (-sizes[k], k)):
        n, i = heapq.heappop(heap)
        parts[i].append(k)
        heapq.heappush(heap, (n + sizes[k], i))
    lengths = dict((i, n) for n, i in heap)
    order = sorted(lengths, key=lambda i: (-lengths[i], i))
    r = np.random.default_rng(s.seed)
    x = np.full((max(lengths.values()), len(parts)), END, np.uint16)
    y = np.full(x.shape, -1, np.int32)
    new = np.zeros(x.shape, bool)
    for lane, i in enumerate(order):
        at = 0
        for k in r.permutation(np.array(parts[i], np.int64)).tolist():
            (d, a), n = pieces[k], sizes[k]
            marked = np.concatenate(([END], docs[d][max(0, a - 1) : a + n], [END]))[a > 0 :]  # END, the words, END
            x[at : at + n, lane] = marked[:n]
            y[at : at + n, lane] = outputs_of(marked[1 : n + 1].astype(np.int32), s)
            new[at, lane] = True
            at += n
    return x, y, new


def gradients(p: dict, xs: np.ndarray, ys: np.ndarray, starts: np.ndarray, state: np.ndarray, s: Settings, g: dict) -> tuple[np.ndarray, int, float]:
    """The states after a window and its number of outputs and minus their log likelihood, of which g gets the gradients.

    xs, ys, starts: (time, lanes); the gradient ends at the window's beginning, and where a document begins.
    """
    width, lanes, h = len(xs), xs.shape[1], s.hidden
    real = ys >= 0
    used = np.flatnonzero(np.bincount(xs.reshape(-1), minlength=len(p["embed"])))
    place = np.empty(len(p["embed"]), np.int64)
    place[used] = np.arange(len(used))
    inverse = place[xs]
    projected = p["embed"][used] @ p["in"] + p["in_b"]
    hs, kept = np.empty((h, width, lanes), projected.dtype), []
    fresh = starts.any(axis=1)
    for t in range(width):
        if fresh[t]:
            state = state * ~starts[t]
        state = step(np.ascontiguousarray(projected.take(inverse[t], axis=0).T), state, p["u"], kept)
        hs[:, t] = state
    flat, every = hs.reshape(h, -1), bool(real.all())
    logp, dhs = output_scores(p, flat if every else flat[:, real.reshape(-1)], ys[real], s, g)
    if not every:
        some, dhs = dhs, np.zeros((h, real.size), projected.dtype)
        dhs[:, real.reshape(-1)] = some
    dhs = dhs.reshape(h, width, lanes)
    dh = np.zeros((h, lanes), projected.dtype)
    dx = np.empty((3 * h, width, lanes), projected.dtype)
    for t in range(width - 1, -1, -1):
        dh += dhs[:, t]
        dx[:, t], dh = back(kept[t], dh, p["u"], g["u"])
        if fresh[t]:
            dh *= ~starts[t]
    dx = dx.reshape(3 * h, -1)
    g["in"] += p["embed"][used].T.take(inverse.reshape(-1), axis=1) @ dx.T
    g["in_b"] += dx.sum(axis=1)
    g["embed"][used] += summed_by(inverse.reshape(-1), np.ascontiguousarray((p["in"] @ dx).T), len(used))
    return state, int(real.sum()), -float(logp.sum())


def train(flat: np.ndarray, docs: list[np.ndarray], s: Settings) -> int:
    """Trains the weights in place on documents given as input ids; returns the number of tokens, ends included.

    Documents go through side by side in s.lanes lanes, window by window, each with a state of its own from its first word to
    its end. A window is a step of Adam.
    """
    if not docs:
        return 0
    x, y, new = laid_out(docs, s)
    p, adam = views(flat, s), Adam({"all": flat}, s.rate)
    grad = np.empty_like(flat)
    g = views(grad, s)
    state = np.zeros((s.hidden, x.shape[1]), np.float32)
    for t0 in range(0, len(x), s.window):
        ys = y[t0 : t0 + s.window]
        lanes = int((ys[0] >= 0).sum())
        grad[:] = 0
        state, n, _ = gradients(p, x[t0 : t0 + s.window, :lanes], ys[:, :lanes], new[t0 : t0 + s.window, :lanes], state[:, :lanes], s, g)
        adam.update({"all": grad}, clip=1.0, scale=1 / n)
    return sum(len(d) + 1 for d in docs)


def score(flat: np.ndarray, docs: list[np.ndarray], s: Settings) -> np.ndarray:
    """Natural log likelihood of each document's words and end. Documents go through side by side, longest first, window by window."""
    p = views(flat, s)
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    ids = np.full(int(sizes.sum()) + 1, END, np.uint16)
    for a, d in zip((np.cumsum(sizes) - sizes).tolist(), docs):
        ids[a + 1 : a + 1 + len(d)] = d
    table = p["embed"] @ p["in"] + p["in_b"]
    result = np.zeros(len(sizes))
    sizes = sizes[order]
    state = np.zeros((s.hidden, len(sizes)), np.float32)
    held: list[tuple] = []

    def flush():
        if held:
            hs, target, doc = (np.concatenate(x, axis=-1) for x in zip(*held))
            held.clear()
            logp, _ = output_scores(p, hs, target, s)
            result[:] += np.bincount(doc, weights=logp, minlength=len(result))

    waiting = 0
    for t0 in range(0, int(sizes[0]) if len(sizes) else 0, s.window):
        active = int(np.searchsorted(-sizes, -t0, "left"))
        state = state[:, :active]
        width = min(s.window, int(sizes[0]) - t0)
        hs = np.empty((s.hidden, width, active), np.float32)
        steps = t0 + np.arange(width)[:, None]
        real = steps < sizes[:active]
        last = steps == sizes[:active] - 1
        at = np.minimum(first[:active] + steps, len(ids) - 2)
        # The word behind a document's last one is the next document's mark, which is the end's id.
        target = np.where(last, END, outputs_of(ids[at + 1].astype(np.int32), s))
        inputs = np.where(steps == 0, END, ids[at])
        for t in range(width):
            state = step(np.ascontiguousarray(table.take(inputs[t], axis=0).T), state, p["u"])
            hs[:, t] = state
        keep = real.reshape(-1)
        held.append((hs.reshape(s.hidden, -1)[:, keep], target[real], np.broadcast_to(order[:active], real.shape)[real]))
        waiting += int(keep.sum())
        if waiting >= FLUSH:
            flush()
            waiting = 0
    flush()
    return result


#: A weight times this is kept as an integer, so that sums over shards don't depend on their order.
FIXED_POINT = 2.0**32
#: Weights in a row of a shard's results.
BLOCK = 16384


def shard_mean(rows: DataFrame) -> np.ndarray | None:
    """The mean of all shards' weights, given as rows (block, part, shards, w): first within each part, then over the parts."""

    def add(t: pa.Table) -> pa.Table:
        w = np.zeros(len(t.column("w")[0].as_py()) // 8, np.int64)
        for x in t.column("w"):
            w += np.frombuffer(x.as_buffer(), np.int64)
        total = pc.sum(t.column("shards")).as_py()
        return pa.table([t.column("block")[:1], t.column("part")[:1], pa.array([total], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["block", "part", "shards", "w"])

    kind = "block int, part int, shards long, w binary"
    sums = rows.groupBy("block", "part").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind).collect()
    if not sums:
        return None
    sums.sort(key=lambda r: r.block)
    return (np.concatenate([np.frombuffer(r.w, np.int64) for r in sums]) / (FIXED_POINT * sums[0].shards)).astype(np.float32)


def trained(coded_rows: DataFrame, v: Vocabulary, s: Settings) -> np.ndarray:
    """Mean weights after the rounds. coded_rows: round, key (a hash of the document) and ids."""
    sc = coded_rows.sparkSession.sparkContext
    flat = start_weights(v, s)
    for i, share in enumerate(s.rounds):
        shards = max(1, round(share * v.total / s.shard_tokens))
        parts = max(1, round(shards**0.5))
        held = sc.broadcast(flat)

        def run(t: pa.Table) -> pa.Table:
            rows = sorted(zip(t.column("key").to_pylist(), t.column("ids").to_pylist()))
            mine = held.value.copy()
            train(mine, [np.frombuffer(x, np.uint16) for _, x in rows], s)
            fixed = np.rint(mine * FIXED_POINT).astype(np.int64)
            blocks = [fixed[a : a + BLOCK].tobytes() for a in range(0, len(fixed), BLOCK)]
            part = t.column("shard")[0].as_py() % parts
            n = len(blocks)
            return pa.table([pa.array(np.arange(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([1] * n, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "part", "shards", "w"])

        mine = coded_rows.where(F.col("round") == i).select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "ids")
        mean = shard_mean(mine.groupBy("shard").applyInArrow(run, "block int, part int, shards long, w binary"))
        flat = flat if mean is None else mean
        held.unpersist()
    return flat


def coded_documents(docs: DataFrame, v: Vocabulary, s: Settings, text: str) -> DataFrame:
    """A stored row per document: its round (-1: held out), key, ids, and the base score as far as the known words go."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = spark.sparkContext.broadcast((v.words, v.counts, v.ends, v.total, v.distinct))

    def run(batches):
        vocabulary = Vocabulary(*held.value)
        log_known = np.log10(vocabulary.counts + 0.1)
        end_log = float(np.log10(vocabulary.ends + 0.1))
        row = TaskContext.get().partitionId() << 40
        for batch, texts in text_batches(batches, text, s.chunk_bytes):
            t = Tokens(texts, lower=True)
            doc, docs_n, ends = t.texts(), len(t.sizes), t.ends()
            place, into = coded(t, vocabulary, s)
            stream = into.astype(np.uint16)[t.index].tobytes()
            ids = [stream[2 * a : 2 * b] for a, b in zip((ends - t.sizes).tolist(), ends.tolist())]
            known = place[t.index] >= 0
            logs = np.append(log_known, 0.0)[place][t.index]
            in_tail = into[t.index] >= s.outputs
            total = lambda x: np.bincount(doc, weights=x, minlength=docs_n)
            rare = np.flatnonzero(~known)
            pair = np.sort(doc[rare] * len(t.words) + t.index[rare])
            fresh = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
            times = np.diff(np.append(fresh, len(pair)))
            of, word = np.divmod(pair[fresh], max(1, len(t.words)))
            offsets = np.append(0, np.cumsum(np.bincount(of, minlength=docs_n))).astype(np.int32)
            columns = {
                "doc_id": batch.column(0),
                "round": batch.column(1),
                "key": batch.column(2),
                "row": pa.array(np.arange(row, row + docs_n)),
                "n_tokens": pa.array(t.sizes + 1),
                "known": pa.array(total(known).astype(np.int64) + int(vocabulary.ends > 0)),
                "logs": pa.array(total(logs) + end_log),
                "tail_logs": pa.array(total(logs * in_tail)),
                "tail": pa.array(total(in_tail).astype(np.int64)),
                "ids": pa.array(ids, pa.binary()),
                "words": pa.ListArray.from_arrays(pa.array(offsets), t.words.take(pa.array(word))),
                "times": pa.ListArray.from_arrays(pa.array(offsets), pa.array(times, pa.int64())),
            }
            row += docs_n
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    key = F.xxhash64(F.col(text), F.col("doc_id"), F.lit(s.seed))
    cuts = [round(1_000_000 * sum(s.rounds[: k + 1])) for k in range(len(s.rounds) - 1)]
    turn = F.lit(0)
    for cut in cuts:
        turn = turn + (F.pmod(key, F.lit(1_000_000)) >= cut).cast("int")
    schema = f"doc_id {kind}, round int, key long, row long, n_tokens long, known long, logs double, tail_logs double, tail long, ids binary, words array<string>, times array<long>"
    rows = docs.select("doc_id", F.when(held_out(), -1).otherwise(turn).cast("int").alias("round"), key.alias("key"), text).mapInArrow(run, schema)
    path = scratch(spark, "coded")
    rows.write.partitionBy("round").parquet(path)  # a round reads its own documents only
    return spark.read.schema(rows.schema).parquet(path)


def with_scores(docs: DataFrame, text: str = "text", s: Settings = Settings()) -> DataFrame:
    """doc_id and the scores of each whole text of docs, learnt from those that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. Tokens are the words between ASCII
    white space, with A-Z in lower case, then one end. A null or empty text is the end alone. Repeated rows are scored alike and
    count as often as they are there. With no training document all words are unknown. An empty table gives no rows;
    further columns are not used. Scores don't depend on the order of the rows or on how they are partitioned, but for
    roundings of single precision in the sums of a document's tokens.
    """
    if s.outputs + s.endings > 1 << 16:
        raise ValueError("ids are stored as 16 bits")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = stored(gathered_counts(docs, s, text), "word-counts")
    v = vocabulary(counts, s)
    rows = coded_documents(docs, v, s, text)
    held = spark.sparkContext.broadcast(trained(rows, v, s))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(x, np.uint16) for x in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), *(batch.column(k) for k in range(6, 9)), pa.array(score(held.value, ids, s) / LN10)], names=["doc_id", "round", "row", "n_tokens", "known", "logs", "tail_logs", "tail", "model"])

    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + F.lit(0.1))).alias("rare_logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    scored = rows.select("doc_id", "round", "row", "n_tokens", "known", "ids", "logs", "tail_logs", "tail").mapInArrow(run, f"doc_id {kind}, round int, row long, n_tokens long, known long, logs double, tail_logs double, tail long, model double")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        "doc_id",
        (F.col("round") < 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * float(np.log10(v.mass))).alias("base_score"),
        (F.col("model") + F.col("tail_logs") + rare_logs - F.col("tail") * float(np.log10(v.tail_mass(s)))).alias("score"),
    )
