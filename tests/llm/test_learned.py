"""Operators that learn: held-out quality, proper distributions, and rows that are awkward."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweir.llm import gru_lm, langid, queries, toxicity
from logweir.llm.hashing import U, words as hashed

from .helpers import awkward, documents, words

SF = "/root/testdata/sf0.01"
fold = lambda i: zlib.crc32(str(i).encode()) % 5


# toxicity


def test_grammar_scores_clauses():
    m = toxicity.Matcher(())
    kinds = lambda t: {toxicity.KINDS[i]: int(n) for i, n in enumerate(m.counts(t)) if n}
    assert kinds("You are an idiot.") == {"insult aimed": 1}
    assert kinds("What an idiot; nothing else.") == {"insult": 1}
    assert kinds("She is not an idiot.") == {"insult negated": 1}
    assert kinds("They said the word idiot was used.") == {"insult reported": 1}
    assert kinds("He wrote a long letter to the mayor calling him an idiot!") == {"insult reported": 1}
    assert kinds("I will kill you. The idiot") == {"threat": 1, "insult": 1}
    assert kinds("He and she will not hurt them, you moron") == {"threat negated": 1, "insult aimed": 1}
    assert kinds("Not now. You idiot") == {"insult aimed": 1}
    assert kinds("") == kinds(None) == kinds("the idiosyncratic clownfish trashed") == {}
    weights = toxicity.PRIOR
    score = lambda t: float(toxicity.score(m.counts(t), weights, toxicity.PRIOR_BIAS))
    assert score("You idiot") > 0.5 > score("She is not an idiot") and score("You idiot") > score("they said idiot")


def test_composition_is_that_of_the_machines():
    a, b, c = toxicity._negation(), toxicity._reported(), toxicity._aimed()
    rng = random.Random(0)
    for _ in range(200):
        s, p, q, r = toxicity.GRAMMAR.start, a.start, b.start, c.start
        for x in (rng.randrange(6) for _ in range(12)):
            out, s = toxicity.GRAMMAR.arcs[s, x]
            mid, p = a.arcs[p, x]
            mid, q = b.arcs[q, mid]
            last, r = c.arcs[r, mid]
            assert out == last


def test_toxicity_on_held_out_documents(spark):
    got = queries.QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r["held_out"] == (fold(r["doc_id"]) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in held])
    found = np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == 1])
    clean = np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == 0])
    assert right >= 0.96 and found >= 0.9 and clean <= 0.03, (right, found, clean)


def test_stems_of_a_small_language_are_learned_beside_a_large_one(spark):
    rng = random.Random(7)
    some = lambda: " ".join(f"{a}{b}en" for a in "klmnp" for b in rng.sample("aeiou", 2))
    rows = [(f"{some()} {i}", 0) for i in range(600)] + [(f"{some()} grobian {i}", 1) for i in range(400)]
    rows += [(f"{some()} bomenter {i}", 1) for i in range(toxicity.LEAST)] + [(f"{some()} solitario", 1)] * 30
    stems = toxicity.learn_stems(spark.createDataFrame(rows, "text string, toxic int"))
    starts = lambda w: any((w + "$").startswith(s) for s in stems)
    assert starts("grobian") and starts("bomenter")
    assert not starts("solitario")  # thirty copies of one text are one


def test_toxicity_without_labels_and_with_awkward_rows(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none)
    assert model.stems == () and (model.weights == toxicity.PRIOR).all()
    odd = spark.createDataFrame([(4, None), (4, 1), (None, 1), (99, 0)], "doc_id long, toxic int")
    kept = toxicity.reject(docs, odd)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.reject(docs.limit(0), odd).count() == 0
    bad = documents(spark, [(1, "you idiot", "s"), (2, "fine", "s")])
    assert [r["doc_id"] for r in toxicity.reject(bad, none).collect()] == [2]


# language


def test_language_on_held_out_documents(spark):
    got = queries.QUERIES["op7_language_id"](spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["held_out"] == (fold(r["doc_id"]) == 0) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got if r["held_out"]]) >= 0.97
    assert np.mean([r["rejected"] for r in got]) < 0.05


def test_language_of_awkward_rows(spark):
    docs = documents(spark, [(1, None, "s"), (2, "", "s"), (3, "123 !? 🙂", "s"), (4, "hello there world", "s"), (5, "hello there world", "s")])
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["und", "und", "und", "en", "en"] and got[3]["score"] == 0 and got[4]["score"] == got[5]["score"]
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0 and langid.identify(awkward(spark)).count() == 10


def test_subwords_against_a_plain_version():
    def plain(text):
        out, low = [], (text or "").lower()
        bare = "".join(c if c.isalpha() else " " for c in low)
        for w in bare.split():
            w = f"\1{w}\1"
            for k in langid.ORDERS:
                out += [w[i : i + k] for i in range(len(w) - k + 1) if not (k == 1 and w[i] == "\1")]
        return out

    for t in ("Héllo wörld", "a b", "x", "  ab1cd  ", "ÀÉ-ñ 🙂 z"):
        assert len(langid.subwords(t)) == len(plain(t)), t
    a, b = langid.subwords("abc"), langid.subwords("abc abc")
    assert sorted(np.concatenate([a, a])) == sorted(b)


# language model


def test_base_score_and_gain_on_held_out_documents(spark):
    got = queries.QUERIES["op9_gru_scoring"](spark, SF).collect()
    texts = {r["doc_id"]: words(r["text"]) + [None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    c = {}
    for i, t in texts.items():
        if fold(i) != 1:
            for w in t:
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"]) == 1, len(t), sum(w in c for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) > sum(r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) + 0.1


def tiny_net():
    texts = [np.append(w, gru_lm.END) for t in ["a b c a b", "b a c", "c c a b"] * 250 for _, w, _ in hashed(pa.array([t]))]
    tokens = np.array(sorted({int(x) for t in texts for x in t}), U)
    return gru_lm.train(texts, tokens), texts


def test_network_gives_a_distribution_and_carries_its_state(monkeypatch):
    net, texts = tiny_net()
    size = len(net.tokens)
    p = [math.exp(gru_lm.log_probs(net, [np.array([1, 2, y])])[2]) for y in range(size + 1)]
    assert sum(p) == pytest.approx(1, abs=1e-5)
    lines = [gru_lm.numbers(net, t) for t in texts[:7:250]] + [gru_lm.numbers(net, t) for t in texts[100:600:100]] + [np.array([0])]
    whole = gru_lm.log_probs(net, lines)
    monkeypatch.setattr(gru_lm, "WINDOW", 1)
    assert gru_lm.log_probs(net, lines) == pytest.approx(whole, abs=1e-5)
    alone = np.concatenate([gru_lm.log_probs(net, [x]) for x in lines])
    assert alone == pytest.approx(whole, abs=1e-4)
    # it has learned: better than guessing
    assert whole[:-1].mean() > -math.log(size)


def test_training_beats_an_untrained_network():
    net, texts = tiny_net()
    before = gru_lm.log_probs(gru_lm.train([], net.tokens)._replace(share=1.0), [gru_lm.numbers(net, texts[0])]).sum()
    assert gru_lm.log_probs(net, [gru_lm.numbers(net, texts[0])]).sum() > before + 3


def test_scores_of_awkward_rows(spark):
    docs = awkward(spark)
    got = gru_lm.score(docs, F.col("doc_id") == 7).collect()
    assert len(got) == docs.count() and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert gru_lm.score(docs.limit(0), F.lit(False)).count() == 0
    lone = gru_lm.score(documents(spark, [(1, "a b", "s")]), F.lit(True)).collect()
    assert lone[0]["base_score"] == pytest.approx(0.0) and lone[0]["train_tokens"] == 0


def test_blocks_do_not_change_counts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = lambda: {r["doc_id"]: (r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in gru_lm.score(docs, F.col("doc_id") % 5 == 1).collect()}
    want = rows()
    monkeypatch.setattr(gru_lm, "BLOCK", 3000)
    monkeypatch.setattr(gru_lm, "RANGE", 2000)
    assert rows() == want


def test_network_learns_from_documents_behind_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "SAMPLE", 3000)
    rng = random.Random(5)
    n = 9001 + 2400 * 9
    chosen = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(gru_lm.SAMPLE / n * (1 << 30))
    low = spark.range(-400, 0).where(chosen).first()[0]  # was in the sample, and ended it
    noise = " ".join(f"x{rng.randrange(40)}" for _ in range(9000))
    orders = [rng.sample("abcdefgh", 8) for _ in range(2)]
    rows = [(low, noise, "s")] + [(i, " ".join(orders[i % 2]), "s") for i in range(1, 2401)] + [(i, " ".join(orders[i % 2]), "s") for i in range(5001, 5021)]
    got = gru_lm.score(documents(spark, rows), F.col("doc_id") > 5000).where("held_out").collect()
    assert len(got) == 20 and all(r["score"] > r["base_score"] + 4 for r in got), got[0]


def test_rounds_learn_from_every_training_token_and_know_more(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 5 == 1).alias("held_out"))
    monkeypatch.setattr(gru_lm, "BLOCK", 9000)
    blocks = gru_lm.coded(docs).persist()
    n = blocks.agg(F.sum("trained")).first()[0]
    vocabulary = np.unique(np.concatenate([np.frombuffer(r[0], U) for r in blocks.select("vocabulary").collect()]))
    net, total = gru_lm.untrained(vocabulary[:500]), 0
    for i in range(gru_lm.ROUNDS):
        net, judged, seen = gru_lm.improved(blocks, net, n, i, 11, lambda net, lines: np.array([float(sum(map(len, lines)))]))
        total += seen
    assert total == n == sum(len(words(r["text"])) + 1 for r in docs.where("not held_out").collect()) and 0 < judged[0] < n / 4
    assert gru_lm.known_size(16 * gru_lm.SAMPLE) == 2 * gru_lm.known_size(gru_lm.SAMPLE) == 2 * gru_lm.KNOWN
    blocks.unpersist()


# pipeline


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    from logweir.llm import decontam

    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    assert [len(pipeline.STAGES), pipeline.ORACLE_SQL] == [5, None]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, base)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        else:
            assert out.columns[: len(docs.columns)] == docs.columns
        assert stage(spark, docs.limit(0), base).count() == 0
    rows = pipeline.run(spark, base).collect()
    assert rows and not {r["doc_id"] for r in decontam.with_leaks(docs, spark.read.parquet(f"{base}/benchmark.parquet")).where(F.size("leaks") > 0).collect()} & {r["doc_id"] for r in rows}
