"""Language identification: averaged embeddings of hashed subwords with a linear softmax.

Words are runs of letters, lower-cased, with a boundary mark on either side; their subwords are the 1- to 4-grams of code points,
hashed into BUCKETS rows of an embedding matrix. A text is the mean of the embeddings of all its subwords. Matrix and
softmax are trained together by stochastic gradient descent in numpy. The temperature of the softmax and the score below
which a prediction is rejected are calibrated on a part of the sample that training does not see.

The model is fitted on about SAMPLE documents with a language; every text is scored whole. The model has a fixed size
(BUCKETS x DIM floats) and goes to the workers once each.

Defined results: a null text, an empty one or one without letters gives `und` with score 0, and is rejected; nulls in lang are
not learned from; ties between languages go to the first in sorted order; with nothing to learn from all is `und`; repeated rows
are scored alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import lean, remainder, sampled, table

BUCKETS = 1 << 15
DIM = 16
#: Documents the model is fitted on, in expectation, chosen by a hash of their id.
SAMPLE = 3000
#: Of the sample, the part kept for calibration.
CALIBRATION = 0.2
EPOCHS = 8
RATE = 0.1
BATCH = 32
#: Share of right predictions that calibration keeps when it sets the score of rejection, and the highest such score.
KEEP, MOST = 0.995, 0.9
ORDERS = (1, 2, 3, 4)
UND = "und"
_MARK = 1


class Model(NamedTuple):
    langs: tuple[str, ...]
    matrix: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM x languages
    bias: np.ndarray
    temperature: float
    reject_below: float


def codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased words, each run of other characters as one mark, with a mark at either end."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(raw):
        return np.empty(0, np.uint32)
    seen, back = np.unique(raw, return_inverse=True) if len(raw) > 1 << 16 else (None, None)
    if seen is None:
        ascii_ = raw < 128
        low = raw | 32
        letter = ascii_ & (low >= 97) & (low <= 122)
        if not ascii_.all():
            other = ~ascii_
            some, where = np.unique(raw[other], return_inverse=True)
            letter[other] = np.array([chr(c).isalpha() for c in some.tolist()])[where]
    else:
        letter = np.array([chr(c).isalpha() for c in seen.tolist()])[back]
    if not letter.any():
        return np.empty(0, np.uint32)
    out = np.where(letter, raw, _MARK)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first mark after a word stays
    out = out[keep]
    return np.concatenate([np.array([_MARK], np.uint32), out, np.array([_MARK], np.uint32)])


def subwords(text: str | None) -> np.ndarray:
    """Rows of the matrix for every subword occurrence of the whole text."""
    c = codes(text)
    if not len(c):
        return np.empty(0, np.int64)
    x = c.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    mark, out = c == _MARK, []
    for k in ORDERS:
        n = len(c) - k + 1
        if n <= 0:
            break
        h = np.full(n, k, np.uint32)
        for i in range(k):
            h = (h ^ x[i : i + n]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        inner = np.zeros(n, bool)  # a subword has marks at its ends only
        for i in range(1, k - 1):
            inner |= mark[i : i + n]
        if k == 1:
            inner = mark
        elif k == 2:
            inner = mark[:n] & mark[1 : 1 + n]
        out.append((h[~inner] >> np.uint32(32 - (BUCKETS - 1).bit_length())).astype(np.int64))
    return np.concatenate(out)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model | None:
    """A model of the languages in labels, or None without any."""
    return fitted([np.unique(subwords(t), return_counts=True) for t in texts], labels, seed)


def fitted(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int) -> Model | None:
    """The same from the subwords of each text and how often it has them."""
    langs = tuple(sorted(set(labels)))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    usable = np.array([i for i, b in enumerate(bags) if len(b[0])], np.int64)
    usable = usable[rng.permutation(len(usable))]
    held = usable[: int(len(usable) * CALIBRATION)] if len(usable) >= 50 else usable
    fit = usable[int(len(usable) * CALIBRATION) :] if len(usable) >= 50 else usable
    matrix = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)

    def means(rows: np.ndarray) -> np.ndarray:
        return np.stack([(c[:, None] * matrix[b]).sum(axis=0) / c.sum() for b, c in (bags[i] for i in rows)])

    # steps are scaled by the size of past gradients, each n-gram's by its own
    past_m, past_w, past_b = np.full(BUCKETS, 1e-8, np.float32), np.full(weights.shape, 1e-8, np.float32), np.full(len(langs), 1e-8, np.float32)
    for epoch in range(EPOCHS):
        order, rate = fit[rng.permutation(len(fit))], RATE * (1 - epoch / EPOCHS)
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            v = means(rows)
            p = _softmax(v @ weights + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = p @ weights.T
            g, gb = v.T @ p / len(rows), p.mean(axis=0)
            past_w += g * g
            past_b += gb * gb
            weights -= rate * g / np.sqrt(past_w)
            bias -= rate * gb / np.sqrt(past_b)
            for gv, i in zip(back, rows):
                b, c = bags[i]
                part = (c / c.sum()).astype(np.float32)
                past_m[b] += part * part * (gv @ gv)
                matrix[b] -= rate * (part / np.sqrt(past_m[b]))[:, None] * gv
    scores = means(held) @ weights + bias if len(held) else np.zeros((0, len(langs)), np.float32)
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.25, 4, 60):
        loss = -np.log(np.maximum(_softmax(scores / t)[np.arange(len(held)), y[held]], 1e-12)).mean() if len(held) else 0.0
        if loss < best:
            best, temperature = loss, float(t)
    p = _softmax(scores / temperature) if len(held) else np.zeros((0, len(langs)))
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]] if len(held) else np.zeros(0)
    reject = min(MOST, float(np.quantile(right, 1 - KEEP))) if len(right) else 0.0
    return Model(langs, matrix, weights, bias, temperature, reject)


def _model(docs: DataFrame, seed: int) -> Model | None:
    """The model of a sample, whose subwords are counted in the tasks: a document of any length sends BUCKETS counts at most."""
    known = docs.where("lang is not null and text is not null")
    rows = known.where(sampled(F.col("doc_id"), SAMPLE, known.select("lang").count(), seed)).select("text", "lang")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = [np.unique(subwords(t.as_py()), return_counts=True) for t in batch.column(0)[a : a + 64]]
                cols = (pa.array([i.astype(np.uint16).tobytes() for i, _ in part], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in part], pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(1)[a : a + 64], *cols], names=["lang", "ids", "counts"])

    found = sorted((r["lang"], bytes(r["ids"]), bytes(r["counts"])) for r in rows.mapInArrow(bag, "lang string, ids binary, counts binary").collect())
    # sorted, so that the fit does not depend on the order of partitions
    return fitted([(np.frombuffer(i, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32).astype(np.int64)) for _, i, c in found], [r[0] for r in found], seed)


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected."""
    lean(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table_ = m.matrix @ m.weights if m else None
        for batch in batches:
            lang, score, reject = [], [], []
            for t in batch.column(batch.schema.get_field_index(text)):
                rows = subwords(t.as_py()) if m else ()
                if not len(rows):
                    lang.append(UND), score.append(0.0), reject.append(True)
                    continue
                if len(rows) > 1 << 13:
                    z = np.bincount(rows, minlength=BUCKETS) @ table_ / len(rows)
                else:
                    z = table_[rows].mean(axis=0, dtype=np.float64)
                p = _softmax(((z + m.bias) / m.temperature)[None])[0]
                i = int(p.argmax())
                lang.append(m.langs[i]), score.append(float(p[i])), reject.append(bool(p[i] < m.reject_below))
            new = (pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(of, schema)


def identify(docs: DataFrame, learn: Column | None = None, seed: int = 5) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of docs (doc_id, text, lang); learned where `learn` holds."""
    model = _model(docs.select("doc_id", "text", "lang").where(learn) if learn is not None else docs.select("doc_id", "text", "lang"), seed)
    return predicted(docs.select("doc_id", "text"), model).drop("text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"))
    out = identify(docs, learn=fold != 0)
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")
