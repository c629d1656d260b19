"""Language-model scoring with a gated recurrent network.

Tokens are words (A-Z as a-z) and an end after each text. Two models learn from the training documents:

* counts of every token over all training documents, which give the smoothed unigram base score; and
* a gated recurrent network over the most frequent tokens, trained by truncated backpropagation in numpy, with a
  softmax over classes of tokens and one within the class. Other tokens share the class `rare`, within which they have
  their smoothed share of the counts, so that the network gives a distribution over all tokens, unseen ones included.
  KNOWN tokens are told apart up to SAMPLE training tokens, and more with the fourth root of the training tokens beyond.

The score of a text is the log10 probability of all its tokens under a mixture of both. A document of any length is walked in windows
with its state carried from window to window.

Documents are coded once, in blocks of about BLOCK tokens with a vocabulary each. Counting sends vocabularies, not tokens:
a block's share of a range of hashes goes to the task of that range, and the totals come back to the block. The network
starts from a fit on about SAMPLE tokens, stretches from all over the training documents. Then it learns from every training
document: in each of ROUNDS rounds each worker improves the weights on its blocks' documents of that round, and the weights of
the workers are averaged by their tokens. A worker has PER_WEIGHT tokens for each weight, so what is sent stays a fraction of what is read. The network's share in the mixture is chosen on documents kept for the last round, before
they are learned from. Tokens are told apart by 64-bit hashes.

Defined results: a null text is an empty one, whose only token is the end; repeated rows are scored and learned from each;
with no training document all counts are 0 and the base score is that of an empty model; an empty table gives an
empty result; further columns are ignored; ties in frequency go by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, remainder, small_batches, table, written
from .hashing import U, words

#: Tokens of a block, of the sample that the fit starts from, and distinct tokens of a range that is counted in one task.
BLOCK, SAMPLE, RANGE = 1_000_000, 300_000, 1_000_000
#: Tokens that the network tells apart and their classes, at least, and its width.
KNOWN, CLASSES, WIDTH = 2048, 32, 24
#: Bound of the weights of the outputs: no sum of WIDTH of them and one more has an exponential that overflows.
LIMIT = np.float32(min(3.0, 80 / (WIDTH + 1)))
#: Truncated backpropagation: steps, parallel texts, passes, rate of learning.
STEPS, STREAMS, PASSES, RATE = 24, 48, 4, 0.01
#: The same over all training documents: rounds, parallel texts, rates of learning of the first and the last round.
ROUNDS, WIDE, RATES = 4, 256, (0.004, 0.001)
#: Training tokens of a worker for each weight that it sends.
PER_WEIGHT = 32
#: Tokens of a stretch of the sample, tokens on which the share is chosen (a tenth of all at most), floats of a part of the weights.
STRETCH, CHECK, PART = 512, 100_000, 1 << 18
#: Tokens whose outputs are computed at a time.
WINDOW = 1 << 14
END = U(0xE4D)
RARE = 0


class Net(NamedTuple):
    tokens: np.ndarray  # sorted hashes of the known tokens
    ids: np.ndarray  # their numbers from 1 on; 0 is rare
    klass: np.ndarray  # class of each number; rare is class 0, alone
    cuts: np.ndarray  # first number of each class, and the end
    params: dict[str, np.ndarray]
    share: float  # of the network in the mixture


def _gate(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def known_size(n: int) -> int:
    """Tokens told apart after n training tokens."""
    return int(KNOWN * max(1.0, n / SAMPLE) ** 0.25)


def _classes(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of numbers 0 to size and the first number of each class: rare alone, the others by frequency in classes whose sizes grow
    with the root of the rank, so that frequent tokens are in small ones."""
    n = np.arange(size)
    _, k = np.unique((max(CLASSES, int(0.65 * size**0.5)) * np.sqrt((n + 0.5) / max(1, size))).astype(int), return_inverse=True)
    klass = np.concatenate([[0], 1 + k]).astype(np.int16)  # sorted by radix
    return klass, np.searchsorted(klass, np.arange(klass[-1] + 2))


def _outputs(net: Net, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the numbers y after the states h. Weights are bounded, so no exponential overflows."""
    p = net.params
    k = net.klass[y]
    order = np.argsort(k, kind="stable")
    h, y, k = h[order], y[order], k[order]
    ends = np.searchsorted(k, np.arange(len(net.cuts)))
    z = h @ p["C"]
    z += p["c"]
    got = z[np.arange(len(k)), k]
    got -= np.log(np.exp(z, out=z).sum(axis=1))
    for c in range(1, len(ends) - 1):
        i, j = ends[c], ends[c + 1]
        if i < j:
            a, b = net.cuts[c], net.cuts[c + 1]
            z = h[i:j] @ p["W"][a:b].T
            z += p["w"][a:b]
            got[i:j] += z[np.arange(j - i), y[i:j] - a]
            got[i:j] -= np.log(np.exp(z, out=z).sum(axis=1))
    out = np.empty(len(k), np.float32)
    out[order] = got
    return out


def untrained(tokens: np.ndarray, seed: int = 11) -> Net:
    """A network for tokens (hashes, the most frequent first)."""
    rng = np.random.default_rng(seed)
    size, d = len(tokens), WIDTH
    order = np.argsort(tokens)
    klass, cuts = _classes(size)
    n_classes = len(cuts) - 1
    rand = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    p = {"E": rand(size + 2, d), "X": rand(d, 3 * d), "U": rand(d, 3 * d), "b": np.zeros(3 * d, np.float32), "C": rand(d, n_classes), "c": np.zeros(n_classes, np.float32), "W": rand(size + 1, d), "w": np.zeros(size + 1, np.float32)}
    p["U"][:, : 2 * d] *= 0.5
    return Net(tokens[order], order + 1, klass, cuts, p, 0.0)


class Learner:
    """Improves a copy of a network's weights, by Adam. Rows of E that a step doesn't touch stay as they are."""

    def __init__(self, net: Net):
        self.net = net._replace(params={k: v.copy() for k, v in net.params.items()})
        self.first = {k: np.zeros_like(v) for k, v in net.params.items()}
        self.second = {k: np.zeros_like(v) for k, v in net.params.items()}
        self.t = 0

    def learn(self, lines: list[np.ndarray], rng: np.random.Generator, rate: float, most: int) -> None:
        """One pass over lines of numbers, of which up to `most` streams are walked side by side."""
        mixed = [lines[i] for i in rng.permutation(len(lines))]
        y = np.concatenate(mixed).astype(np.int32)
        begins = np.cumsum([0, *map(len, mixed[:-1])])
        x, fresh = np.empty_like(y), np.zeros(len(y), bool)
        x[1:], x[begins], fresh[begins] = y[:-1], len(self.net.tokens) + 1, True  # the input before the first token
        streams = min(most, max(1, len(y) // (STEPS * 16)))
        length = -(-len(y) // streams)
        cut = lambda a: np.ascontiguousarray(np.resize(a, streams * length).reshape(streams, length).T)  # noqa: E731  # the last stream is filled from the beginning
        x, y, fresh = cut(x), cut(y), cut(fresh)
        h = np.zeros((WIDTH, streams), np.float32)
        for a in range(0, length, STEPS):
            h = self._steps(x[a : a + STEPS], y[a : a + STEPS], [np.flatnonzero(f) for f in fresh[a : a + STEPS]], h, rate)

    def _steps(self, x: np.ndarray, y: np.ndarray, fresh: list[np.ndarray], h: np.ndarray, rate: float) -> np.ndarray:
        """Improves the weights by one stretch of all streams, and gives the states after it. Arrays have a row for each unit and a column
        for each stream, so that all their parts lie in one piece."""
        p, d = self.net.params, WIDTH
        steps, streams = x.shape
        inputs = p["E"][x]
        xw = np.matmul(p["X"].T, inputs.transpose(0, 2, 1))
        xw += p["b"][:, None]
        gates, turned = xw[:, : 2 * d], np.ascontiguousarray(p["U"].T)
        before, new, kept, states = (np.empty((steps, d, streams), np.float32) for _ in range(4))
        for s in range(steps):
            before[s] = h
            before[s][:, fresh[s]] = 0
            u = turned @ before[s]
            z = gates[s]
            z += u[: 2 * d]
            _gate(z)
            kept[s] = u[2 * d :]
            n = new[s]
            np.multiply(z[d:], u[2 * d :], out=n)
            n += xw[s, 2 * d :]
            np.tanh(n, out=n)
            h = states[s]
            np.subtract(before[s], n, out=h)
            h *= z[:d]
            h += n
        g, back = self._output_gradients(states.transpose(0, 2, 1).reshape(-1, d), y.reshape(-1))
        back = np.ascontiguousarray(back.reshape(steps, streams, d).transpose(0, 2, 1))
        z, r = gates[:, :d], gates[:, d:]
        rest = 1 - z
        by_z = before - new
        by_z *= z
        by_z *= rest
        np.multiply(new, new, out=new)
        np.subtract(1, new, out=new)
        by_new = np.multiply(rest, new, out=rest)
        kept *= r
        np.subtract(1, r, out=new)
        by_r = np.multiply(kept, new, out=kept)
        dx, du = np.empty((steps, 3 * d, streams), np.float32), np.empty((steps, 3 * d, streams), np.float32)
        carry = np.zeros((d, streams), np.float32)
        for s in range(steps - 1, -1, -1):
            dh, into, own = back[s], dx[s], du[s]
            dh += carry
            np.multiply(dh, by_z[s], out=into[:d])
            np.multiply(dh, by_new[s], out=into[2 * d :])
            np.multiply(into[2 * d :], by_r[s], out=into[d : 2 * d])
            own[: 2 * d] = into[: 2 * d]
            np.multiply(into[2 * d :], r[s], out=own[2 * d :])
            carry = p["U"] @ own
            dh *= z[s]
            carry += dh
            carry[:, fresh[s]] = 0
        g["U"] = np.matmul(before, du.transpose(0, 2, 1)).sum(axis=0)
        g["b"], g["X"] = dx.sum(axis=(0, 2)), np.matmul(dx, inputs).sum(axis=0).T
        x = x.reshape(-1)
        order = np.argsort(x, kind="stable")
        firsts = np.flatnonzero(np.concatenate([[True], np.diff(x[order]) > 0]))
        of_inputs = np.matmul(dx.transpose(0, 2, 1), p["X"].T).reshape(-1, d)
        self._adam([(name, slice(None), v) for name, v in g.items()] + [("E", x[order][firsts], np.add.reduceat(of_inputs[order], firsts, axis=0))], rate, len(x))
        return h

    def _output_gradients(self, flat: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of both softmaxes, summed up, and those of the states."""
        p, cuts = self.net.params, self.net.cuts
        k = self.net.klass[y]
        order = np.argsort(k, kind="stable")
        h, y, k = flat[order], y[order], k[order]
        ends = np.searchsorted(k, np.arange(len(cuts)))
        q = h @ p["C"]
        q += p["c"]
        np.exp(q, out=q)
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(k)), k] -= 1
        g = {"C": h.T @ q, "c": q.sum(axis=0), "W": np.zeros_like(p["W"]), "w": np.zeros_like(p["w"])}
        back = q @ p["C"].T
        for c in range(1, len(ends) - 1):
            i, j = ends[c], ends[c + 1]
            if i < j:
                at = slice(cuts[c], cuts[c + 1])
                q = h[i:j] @ p["W"][at].T
                q += p["w"][at]
                np.exp(q, out=q)
                q /= q.sum(axis=1, keepdims=True)
                q[np.arange(j - i), y[i:j] - at.start] -= 1
                np.matmul(q.T, h[i:j], out=g["W"][at])
                g["w"][at] = q.sum(axis=0)
                back[i:j] += q @ p["W"][at]
        out = np.empty_like(back)
        out[order] = back
        return g, out

    def _adam(self, gradients: list, rate: float, n: int) -> None:
        """A step by gradients (name, rows, sum over n tokens)."""
        norm = np.sqrt(sum(float(np.vdot(v, v)) for _, _, v in gradients)) / n
        self.t += 1
        step = np.float32(rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / n)
        for name, at, v in gradients:
            v *= scale
            m, w = self.first[name][at], self.second[name][at]
            q = v * v
            q *= np.float32(0.001)
            w *= np.float32(0.999)
            w += q
            v *= np.float32(0.1)
            m *= np.float32(0.9)
            m += v
            if name == "E":  # copies of rows
                self.first[name][at], self.second[name][at] = m, w
            np.sqrt(w, out=q)
            q += np.float32(1e-8)
            np.divide(m, q, out=q)
            q *= step
            self.net.params[name][at] -= q
            if name in ("C", "c", "W", "w"):
                np.clip(self.net.params[name], -LIMIT, LIMIT, out=self.net.params[name])


def train(texts: list[np.ndarray], tokens: np.ndarray, seed: int = 11) -> Net:
    """A network for tokens (hashes, the most frequent first) from texts of hashes, each ending in END."""
    net = untrained(tokens, seed)
    return started(net, [numbers(net, t) for t in texts if len(t)], seed)


def started(net: Net, lines: list[np.ndarray], seed: int) -> Net:
    """The network after PASSES passes over lines of numbers."""
    if not lines:
        return net
    rng, learner = np.random.default_rng(seed), Learner(net)
    for epoch in range(PASSES):
        learner.learn(lines, rng, RATE * (0.5 if epoch >= PASSES - 1 else 1.0), STREAMS)
    return learner.net._replace(share=1.0)


def _dealt(row: dict, net: Net, n: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The training documents of a block as numbers, and the round of each: about CHECK of n tokens are kept for the last and have -1."""
    rng = np.random.default_rng([seed, row["block"]])
    vocabulary, ends, held = np.frombuffer(row["vocabulary"], U), np.array(row["ends"]), np.array(row["held"], bool)
    y = numbers(net, vocabulary)[np.frombuffer(row["codes"], np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32)]
    rounds = np.where(rng.random(len(ends)) < min(0.1, CHECK / n), -1, rng.integers(ROUNDS, size=len(ends)))
    lines = np.split(y, ends[:-1])
    return [x for x, h in zip(lines, held) if not h], rounds[~held]


def sample(blocks: DataFrame, net: Net, n: int, seed: int) -> list[np.ndarray]:
    """About SAMPLE of n training tokens as lines of numbers: stretches of documents from all blocks, whatever the documents' lengths."""
    sent = blocks.sparkSession.sparkContext.broadcast(net)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines, rounds = _dealt(row, sent.value, n, seed)
                pieces = [x[a : a + STRETCH] for x, r in zip(lines, rounds) if r >= 0 for a in range(0, len(x), STRETCH)]
                take = np.random.default_rng([seed, row["block"], 1]).random(len(pieces)) < SAMPLE / n
                found = [x.astype(np.int32).tobytes() for x, t in zip(pieces, take) if t]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["line"])

    return [np.frombuffer(r[0], np.int32).astype(np.int64) for r in blocks.mapInArrow(of, "line binary").collect()]


def improved(blocks: DataFrame, net: Net, n: int, number: int, seed: int, judge) -> tuple[Net, np.ndarray | None, int]:
    """The network after a round over all blocks, and the tokens learned from; in the last one also judge(net, lines) summed up over the documents
    kept for it, before they are learned from."""
    context = blocks.sparkSession.sparkContext
    sent, last = context.broadcast(net), number == ROUNDS - 1
    rate = RATES[0] + (RATES[1] - RATES[0]) * number / max(1, ROUNDS - 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, weight, judged = Learner(sent.value), 0, []
        for batch in batches:
            for row in batch.to_pylist():
                lines, rounds = _dealt(row, sent.value, n, seed)
                spared = [x for x, r in zip(lines, rounds) if r < 0]
                if last and spared:
                    judged.append(judge(sent.value, spared))
                mine = [x for x, r in zip(lines, rounds) if r == number] + (spared if last else [])
                if mine:
                    learner.learn(mine, np.random.default_rng([seed, row["block"], 2]), rate, WIDE)
                    weight += sum(map(len, mine))
        if weight:
            flat = np.concatenate([v.ravel() for v in learner.net.params.values()])
            for i, a in enumerate(range(0, len(flat), PART)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([weight], pa.int64()), pa.array([flat[a : a + PART].tobytes()], pa.binary())], names=["part", "weight", "values"])
        if judged:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([sum(judged).tobytes()], pa.binary())], names=["part", "weight", "values"])

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = 0.0, 0
        for batch in rows:
            for w, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                total = total + (w * np.frombuffer(v, np.float32).astype(np.float64) if key[0].as_py() >= 0 else np.frombuffer(v, np.float64))
                weight += w
        out = (total / weight).astype(np.float32) if key[0].as_py() >= 0 else total
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([weight], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["part", "weight", "values"])

    shape = "part int, weight long, values binary"
    wanted, cores = -(-n // (PER_WEIGHT * sum(v.size for v in net.params.values()))), max(1, context.defaultParallelism)
    worked = blocks.coalesce(max(1, wanted if wanted <= cores else cores * -(-wanted // cores))).mapInArrow(of, shape)
    with small_batches(blocks.sparkSession):
        parts = {r[0]: r for r in worked.groupBy("part").applyInArrow(add, shape).collect()}
    judged = np.frombuffer(parts.pop(-1)[2], np.float64) if -1 in parts else None
    if not parts:
        return net, judged, 0
    flat, params, at = np.concatenate([np.frombuffer(parts[i][2], np.float32) for i in range(len(parts))]), {}, 0
    for name, v in net.params.items():
        params[name] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return net._replace(params=params, share=1.0), judged, parts[0][1]


def numbers(net: Net, hashes: np.ndarray) -> np.ndarray:
    if not len(net.tokens):
        return np.zeros(len(hashes), np.int32)
    at = np.minimum(np.searchsorted(net.tokens, hashes), len(net.tokens) - 1)
    return np.where(net.tokens[at] == hashes, net.ids[at], RARE).astype(np.int32)


def log_probs(net: Net, lines: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each number of the lines, one after the other. Lines are walked side by side, the longest first, in windows
    between which the states are carried."""
    p, d = net.params, WIDTH
    table_ = p["E"] @ p["X"] + p["b"]
    lengths = np.array([len(x) for x in lines])
    flat, begins = np.concatenate(lines).astype(np.int32), np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # lines longer than each place
    out = np.empty(len(flat), np.float32)
    h, last, turned = np.zeros((d, len(lines)), np.float32), np.full(len(lines), len(net.tokens) + 1), np.ascontiguousarray(p["U"].T)
    at = 0
    while at < lengths[0]:
        states, places = [], []
        stop = at + int(min(max(1, WINDOW // live[at]), lengths[0] - at, 512))
        for s in range(at, stop):
            m = live[s]
            h, x = np.ascontiguousarray(h[:, :m]), np.ascontiguousarray(table_[last[:m]].T)
            u = turned @ h
            z = x[: 2 * d]
            z += u[: 2 * d]
            _gate(z)
            new = u[2 * d :]
            new *= z[d:]
            new += x[2 * d :]
            np.tanh(new, out=new)
            h = h - new
            h *= z[:d]
            h += new
            places.append(begins[:m] + s)
            states.append(h.T)
            last = flat[places[-1]]
        where = np.concatenate(places)
        out[where] = _outputs(net, np.concatenate(states), flat[where])
        at = stop
    return out


def coded(docs: DataFrame) -> DataFrame:
    """Blocks (block, ids, held, ends, codes, vocabulary, counts, trained): ids and folds of their documents, tokens as places in the sorted
    vocabulary, how often each word of it occurs in training documents, and their tokens. docs has doc_id, text and held_out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base, serial = (context.partitionId() if context else 0) << 24, 0
        ids, held, lines, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(lines)
            found = pa.array(flat).dictionary_encode()
            own = found.dictionary.to_numpy()
            place, order = np.empty(len(own), np.int32), np.argsort(own)
            place[order] = np.arange(len(own))
            vocabulary, codes = own[order], place[found.indices.to_numpy()]
            trained = np.repeat(~np.array(held, bool), [len(x) for x in lines])
            counts = np.bincount(codes[trained], minlength=len(vocabulary)).astype(np.int64)
            kind = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
            row = (base + serial, ids, held, np.cumsum([len(x) for x in lines]).tolist(), codes.astype(kind).tobytes(), vocabulary.tobytes(), counts.tobytes(), int(counts.sum()))
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["block", "ids", "held", "ends", "codes", "vocabulary", "counts", "trained"])

        for batch in batches:
            doc, fold = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, w, at in words(batch.column(1)):
                for i in range(len(at) - 1):
                    ids.append(doc[first + i])
                    held.append(fold[first + i])
                    lines.append(np.append(w[at[i] : at[i + 1]], END))
                    size += len(lines[-1])
                    if size >= BLOCK:
                        yield block()
                        ids, held, lines, size, serial = [], [], [], 0, serial + 1
        if lines:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    return rows.mapInArrow(of, "block long, ids array<long>, held array<boolean>, ends array<long>, codes binary, vocabulary binary, counts binary, trained long")


def totals(blocks: DataFrame, ranges: int, most: int) -> DataFrame:
    """(block, range, totals): how often the words of a block within a range of hashes occur in all training documents. Rows
    of block -1 hold a range's figures: tokens, distinct tokens, and the `most` most frequent ones as (hash, count)."""
    edges = np.array([i * ((1 << 64) // ranges) for i in range(1, ranges)], U)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocabulary, counts in zip(*(batch.column(i) for i in range(3))):
                v, c = np.frombuffer(vocabulary.as_py(), U), np.frombuffer(counts.as_py(), np.int64)
                cuts = [0, *np.searchsorted(v, edges).tolist(), len(v)]
                rows = [(i, v[a:b].tobytes(), c[a:b].astype(np.int32).tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block.as_py()] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["range", "block", "words", "counts"])

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, v, c = [], [], []
        for batch in rows:
            block += batch.column(1).to_pylist()
            v += [np.frombuffer(x.as_py(), U) for x in batch.column(2)]
            c += [np.frombuffer(x.as_py(), np.int32) for x in batch.column(3)]
        distinct, at = np.unique(np.concatenate(v), return_inverse=True)
        total = np.bincount(at, np.concatenate(c), len(distinct)).astype(np.int64)
        cuts = np.cumsum([0, *map(len, v)])
        names = ["block", "range", "totals", "tokens", "distinct", "top"]
        types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        top = np.lexsort((distinct, -total))[:most]
        top = top[total[top] > 0]
        best = np.stack([distinct[top], total[top].astype(U)]).tobytes()
        one = (-1, key[0].as_py(), b"", int(total.sum()), int((total > 0).sum()), best)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, types)], names=names)
        for a in range(0, len(block), 64):
            part = range(a, min(a + 64, len(block)))
            cols = ([block[i] for i in part], [key[0].as_py()] * len(part), [total[at[cuts[i] : cuts[i + 1]]].tobytes() for i in part], [0] * len(part), [0] * len(part), [b""] * len(part))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=names)

    split = blocks.select("block", "vocabulary", "counts").mapInArrow(parts, "range int, block long, words binary, counts binary")
    return split.groupBy("range").applyInArrow(add, "block long, range int, totals binary, tokens long, distinct long, top binary")


def score(docs: DataFrame, held_out: Column, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text);
    learned from the rows where held_out is false."""
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    with small_batches(docs.sparkSession):
        blocks = written(coded(docs), "lm-blocks")
    size, n = blocks.agg(F.sum(F.length("vocabulary") / 8), F.sum("trained")).first()
    n, most = n or 0, known_size(n or 0)
    with small_batches(docs.sparkSession):
        counts = written(totals(blocks, max(1, -(-int(size or 0) // RANGE)), most), "lm-counts")
    whole = counts.where("block = -1")
    v = whole.agg(F.sum("distinct")).first()[0] or 0
    best = np.zeros((2, 0), U)
    for row in whole.select("top").toLocalIterator():  # the driver holds 2 * most of them at a time
        best = np.concatenate([best, np.frombuffer(row[0], U).reshape(2, -1)], axis=1)
        best = best[:, np.lexsort((best[0], -best[1].astype(np.int64)))[:most]]
    top_total, n_top = int(best[1].sum()), best.shape[1]
    rare_tokens, rare_words = n - top_total, v - n_top
    often = np.append(1, best[1].astype(np.int64)).astype(float)  # by number; a rare token's count does not change the choice much

    def shares(y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log of a token's share of its number, and its base probability."""
        return np.where(y == RARE, np.log((c + 0.5) / (rare_tokens + 0.5 * (rare_words + 1))), 0.0), (c + 0.5) / (n + 0.5 * (v + 1))

    def mixture(logs: np.ndarray, inside: np.ndarray, base: np.ndarray, share: float) -> np.ndarray:
        """Log10 probabilities of tokens."""
        return np.log(share * np.exp(logs + inside) + (1 - share) * base) / np.log(10)

    def judge(net: Net, lines: list[np.ndarray]) -> np.ndarray:
        y = np.concatenate(lines)
        logs, own = log_probs(net, lines), shares(y, often[y])
        return np.array([mixture(logs, *own, s / 20).sum() for s in range(1, 20)])

    net, judged = untrained(best[0], seed), None
    if n:
        taught = blocks.where("trained > 0").select("block", "held", "ends", "codes", "vocabulary")
        with small_batches(docs.sparkSession):
            net = started(net, sample(taught, net, n, seed), seed)
        for number in range(ROUNDS):
            net, judged, _ = improved(taught, net, n, number, seed, judge)
        net = net._replace(share=0.5 if judged is None else (1 + int(judged.argmax())) / 20)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for ids, held, ends, codes, vocabulary, parts in zip(*(batch.column(i) for i in range(1, 7))):
                v_ = np.frombuffer(vocabulary.as_py(), U)
                c = np.concatenate([np.frombuffer(p["totals"], np.int64) for p in sorted(parts.as_py(), key=lambda p: p["range"])])
                at = np.frombuffer(codes.as_py(), np.uint16 if len(v_) <= 1 << 16 else np.uint32)
                number, ends = numbers(net, v_), np.array(ends.as_py())
                begins = np.concatenate([[0], ends[:-1]])
                (inside, base), y = shares(number, c), number[at]
                each = low = np.log10(base)[at]
                if net.share > 0:
                    logs, each = log_probs(net, [y[a:b] for a, b in zip(begins, ends)]), np.empty(len(at))
                    for a in range(0, len(at), 1 << 17):
                        part = at[a : a + (1 << 17)]
                        each[a : a + (1 << 17)] = mixture(logs[a : a + (1 << 17)], inside[part], base[part], net.share)
                cols = (ids.as_py(), held.as_py(), (ends - begins).tolist(), np.add.reduceat((c > 0).astype(np.int64)[at], begins), [n] * len(ends), np.add.reduceat(low, begins), np.add.reduceat(each, begins))
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    per_block = counts.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("range", "totals")).alias("parts"))
    joined = blocks.select("block", "ids", "held", "ends", "codes", "vocabulary").join(per_block, "block")
    with small_batches(docs.sparkSession):
        return kept(joined.mapInArrow(of, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def op9_gru_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id")) == 1)
