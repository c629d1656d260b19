"""Toxicity by a weighted finite-state pattern grammar.

Texts are cut into clauses. A lexical machine maps the words of a clause to classes (insult, threat, target, negation,
report, other); machines for negation, reported speech and targets are composed with it and with one another into a
single sequential transducer, whose output symbols name the kind of match: plain, aimed at a target, negated or reported.
A weight for each kind is fitted on labelled documents, and a document's score is a logistic function of the weights of
its matched clauses. Words outside a match count for nothing.

Insult stems are learned from labelled documents: prefixes and whole words that stand in LEAST different toxic texts or more and are all
but absent from others, chosen so that they cover each toxic text a few times. Equal texts count once there, and a stem's chance
does not hang on how many other texts are toxic. About SAMPLE labelled documents are learned from;
every text is scored whole.

Defined results: null and empty texts get the score of a text without matches; documents with several labels count as toxic if
one is; null labels are not learned from; without usable labels the stated words and prior weights hold; repeated
rows are scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import lean, packed, remainder, sampled, table, unpacked

#: Labelled documents that lexicon and weights are fitted on, in expectation, chosen by a hash of their id; toxic ones at least.
SAMPLE, TOXIC = 8000, 400
#: Candidate stems that the fit looks at, at most, those in most toxic documents first.
CANDIDATES = 20_000
#: A toxic text asks for so many stems; a stem must serve so many toxic texts.
COVER, LEAST = 4, 3
PREFIXES = (4, 5, 6, 7, 8)

# The words of the classes in English, German, French and Spanish.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile dummkopf abschaum versager salaud crétin ordure imbécile basura estúpido escoria".split()
THREATS = "kill hurt destroy murder beat stab shoot töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours you're he him his she her they them their du dich dir dein deine ihr euch sie tu toi ton ta vous votre il elle te usted ustedes él ella".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't cannot can't nicht kein keine nie pas jamais ne nunca ningún".split()
REPORTS = "said says say called calls wrote writes reported quoted claimed sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Kinds of match, in the order of their weights.
KINDS = ("insult", "insult aimed", "insult negated", "insult reported", "threat", "threat aimed", "threat negated", "threat reported")
#: Weights before any label is seen, and the bias.
PRIOR, PRIOR_BIAS = np.array([1.0, 3.0, -0.5, 0.5, 0.3, 2.5, -0.5, 0.3]), -2.0
#: A negation or a target reaches so many words on.
REACH = 4

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CUT = re.compile(r"[.!?;:\n]+")


class Machine(NamedTuple):
    """A sequential transducer: in a state, an input symbol gives an output symbol and the next state."""

    start: object
    arcs: dict  # (state, symbol) -> (output, state)


def compose(a: Machine, b: Machine, symbols: range | list) -> Machine:
    """Feeds what a puts out to b; only states that can be reached are made."""
    start, arcs, todo, seen = (a.start, b.start), {}, [(a.start, b.start)], {(a.start, b.start)}
    while todo:
        at = todo.pop()
        for x in symbols:
            mid, p = a.arcs[at[0], x]
            out, q = b.arcs[at[1], mid]
            arcs[at, x] = out, (p, q)
            if (p, q) not in seen:
                seen.add((p, q))
                todo.append((p, q))
    return Machine(start, arcs)


def _negation() -> Machine:
    """Marks the first insult or threat up to REACH words after a negation."""
    arcs = {}
    for left in range(REACH + 1):
        for x in range(6):
            after = REACH if x == NEGATION else 0 if x in (INSULT, THREAT) else max(0, left - 1)
            arcs[left, x] = (x, bool(left) and x in (INSULT, THREAT), False), after
    return Machine(0, arcs)


def _reported() -> Machine:
    """Marks insults and threats after a verb of reporting, to the end of the clause."""
    return Machine(False, {(r, (x, n, False)): ((x, n, r and x in (INSULT, THREAT)), r or x == REPORT) for r in (False, True) for x in range(6) for n in (False, True)})


def _aimed() -> Machine:
    """Puts out the kind of each match (-1: none): aimed if a target stands up to REACH words before it."""
    arcs = {}
    for left in range(REACH + 1):
        for x in range(6):
            for n in (False, True):
                for r in (False, True):
                    kind = -1
                    if x in (INSULT, THREAT):
                        kind = (0 if x == INSULT else 4) + (2 if n else 3 if r else 1 if left else 0)
                    arcs[left, (x, n, r)] = kind, REACH if x == TARGET else max(0, left - 1)
    return Machine(0, arcs)


GRAMMAR = compose(compose(_negation(), _reported(), range(6)), _aimed(), range(6))


class Model(NamedTuple):
    stems: tuple[str, ...]  # learned; a final $ ends a whole word
    weights: np.ndarray
    bias: float


class Matcher:
    """Counts the kinds of match in the clauses of a text."""

    def __init__(self, stems: tuple[str, ...]):
        whole = {s[:-1] for s in stems if s.endswith("$")}
        self.insults = frozenset(whole) | set(INSULTS)
        self.prefixes = tuple(s for s in stems if not s.endswith("$"))
        self.classes = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(THREATS, THREAT)
        starts = sorted({*self.insults, *THREATS, *self.prefixes})
        self.seed = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, starts)) + ")")
        self.arcs = {(s, x): v for (s, x), v in GRAMMAR.arcs.items()}

    def symbol(self, word: str) -> int:
        if word in self.insults or self.prefixes and word.startswith(self.prefixes):
            return INSULT
        return self.classes.get(word, OTHER)

    def clause(self, words: list[str]) -> list[int]:
        state, out = GRAMMAR.start, []
        for w in words:
            kind, state = self.arcs[state, self.symbol(w)]
            if kind >= 0:
                out.append(kind)
        return out

    def counts(self, text: str | None) -> np.ndarray:
        got, low, done = np.zeros(len(KINDS)), (text or "").lower(), 0
        for m in self.seed.finditer(low):
            if m.start() < done:
                continue
            end, last = _CUT.search(low, m.end()), done
            done = end.start() if end else len(low)
            first = max(low.rfind(c, last, m.start()) for c in ".!?;:\n") + 1 or last  # each part of the text is looked at once
            for kind in self.clause(_WORD.findall(low, first, done)):
                got[kind] += 1
        return got


def score(counts: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.log1p(counts) @ weights + bias, -30, 30)))


def _stems(text: str | None) -> set[str]:
    out = set()
    for w in set(_WORD.findall((text or "").lower())):
        if len(w) >= 4:
            out.add(w + "$")
            out.update(w[:k] for k in PREFIXES if k <= len(w))
    return out


def _sample(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """Rows (text, toxic) of about SAMPLE labelled documents (of all, if there are no more), and of at least TOXIC toxic ones where these are
    rare; their ids are all that is broadcast."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in known.groupBy(F.col("toxic") > 0).count().collect()}
    total = sum(n.values())
    pick = lambda kind, least: sampled(F.col("doc_id"), max(least, SAMPLE * n.get(kind, 0) // max(1, total)) if total > SAMPLE else total, n.get(kind, 0), seed)
    ids = known.where(F.when(F.col("toxic") > 0, pick(True, TOXIC)).otherwise(pick(False, 0)))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")


def learn_stems(sample: DataFrame) -> tuple[str, ...]:
    """Prefixes and words that mark the toxic texts of sample (text, toxic); equal texts are one, toxic if one of them is."""
    sample = sample.groupBy("text").agg(F.max("toxic").alias("toxic")).persist(StorageLevel.DISK_ONLY)
    try:
        return _learned(sample)
    finally:
        sample.unpersist()


def _learned(sample: DataFrame) -> tuple[str, ...]:
    sizes = {r[0] > 0: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return ()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                found[label.as_py() > 0].update(_stems(text.as_py()))
        names = list(found[0].keys() | found[1].keys())
        for a in range(0, len(names), 50_000):
            part = names[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([found[i][x] for x in part], pa.int64()) for i in (1, 0))], names=["stem", "t", "c"])

    totals = sample.mapInArrow(count, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    fit = totals.where((F.col("t") >= LEAST) & (F.col("c") * 20.0 / clean <= F.col("t") / toxic))
    candidates = {r[0]: r[1] for r in fit.orderBy(F.desc("t"), "stem").limit(CANDIDATES).select("stem", "t").collect()}
    if not candidates:
        return ()
    names = sorted(candidates)
    sent = sample.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(names)})

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(sent.value[s] for s in _stems(t.as_py()) if s in sent.value) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["stems"])

    holders = defaultdict(list)
    for i, row in enumerate(sample.where("toxic > 0").select("text").mapInArrow(held, "stems array<int>").toLocalIterator()):
        for s in row[0]:
            holders[s].append(i)
    asks, sets = np.full(toxic, COVER), {s: np.array(x) for s, x in holders.items()}
    chosen: list[str] = []
    while sets:
        best = max(sets, key=lambda s: (int((asks[sets[s]] > 0).sum()), len(names[s])))
        if (asks[sets[best]] > 0).sum() < LEAST:
            break
        rows, name = sets.pop(best), names[best]
        np.subtract.at(asks, rows, (asks[rows] > 0).astype(asks.dtype))
        chosen.append(name)
        sets = {s: x for s, x in sets.items() if not (names[s].startswith(name.rstrip("$")) or name.rstrip("$").startswith(names[s].rstrip("$")))}
    return tuple(chosen)


def _counted(docs: DataFrame, stems: tuple[str, ...], keep: list[str]) -> DataFrame:
    """The columns in keep and `kinds`, the counts of each kind of match."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(stems)
        for batch in batches:
            kinds = [matcher.counts(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kinds, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "kinds"])

    lean(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = StructType([*rows.drop("_text").schema.fields, StructField("kinds", ArrayType(DoubleType()))])
    return rows.mapInArrow(of, schema)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 3) -> Model:
    """Lexicon and weights from labelled documents."""
    sample = _sample(docs, labels, seed)
    stems = learn_stems(sample)
    rows = _counted(sample, stems, ["toxic"]).collect()
    y = np.array([r[0] > 0 for r in rows], float)
    weights, bias = PRIOR.copy(), PRIOR_BIAS
    if len(rows) and 0 < y.sum() < len(y):
        x = np.column_stack([np.log1p(np.array([r[1] for r in rows])), np.ones(len(y))])
        w, prior = np.append(weights, bias), np.append(PRIOR, PRIOR_BIAS)
        balance = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        pull = np.append(np.full(len(KINDS), 0.5), 0.05)  # unseen kinds keep their prior weights
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ ((p - y) * balance) + pull * (w - prior)
            h = (x * (np.maximum(p * (1 - p), 1e-6) * balance)[:, None]).T @ x + np.diag(pull)
            step = np.linalg.solve(h, g)
            w -= step * min(1.0, 3 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-7:
                break
        weights, bias = w[:-1], float(w[-1])
    return Model(stems, weights, bias)


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default: doc_id), score (0 to 1) and matches, for every row of docs."""
    out = _counted(docs, model.stems, keep or ["doc_id"])
    z = F.lit(float(model.bias))
    for i, w in enumerate(model.weights):
        z = z + F.log1p(F.col("kinds")[i]) * F.lit(float(w))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    matches = F.aggregate("kinds", F.lit(0.0), lambda a, x: a + x).cast("long")
    return out.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("matches", matches).drop("kinds")


def reject(docs: DataFrame, labels: DataFrame, learn: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, that score below the threshold."""
    model = fit(docs.where(learn) if learn is not None else docs, labels)
    return unpacked(scored(packed(docs, "text"), model, ["row"]).where(F.col("score") < threshold))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = remainder(F.col("doc_id"))
    model = fit(docs.where(fold != 0), labels.where(fold != 0))
    out = scored(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matches")
