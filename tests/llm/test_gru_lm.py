import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from auditloom.llm import gru_lm as lm
from tests.llm.fixtures import documents, folder, prose

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans(lm.UPPER, lm.LOWER)


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))


def check(spark, path):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = lm.op6_gru_lm(spark, path).collect()
    assert len(rows) == len(texts)
    counts, ends = Counter(), 0
    for k, t in texts.items():
        if lm.is_training(k):
            counts.update(plain_words(t))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    held = [0.0, 0.0]
    for r in rows:
        words = plain_words(texts[r.doc_id])
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in [*(counts[w] for w in words), ends])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (not lm.is_training(r.doc_id), len(words) + 1, total)
        assert r.n_known == sum(counts[w] > 0 for w in words) + (ends > 0)
        assert abs(r.base_score - base) <= 1e-6 * max(1, abs(base))
        assert math.isfinite(r.score) and r.score < 0
        if r.held_out:
            held[0] += r.base_score
            held[1] += r.score
    return held


def test_base_scores_and_held_out_gain(spark, tmp_path, monkeypatch):
    check(spark, folder(documents(spark), tmp_path / "odd"))
    check(spark, folder(documents(spark, []), tmp_path / "none"))
    monkeypatch.setattr(lm, "HEAD", 3000)  # so that rarer words take the shuffle
    base, score = check(spark, SF)
    print("held out, log10:", base, score)
    assert score > base


def test_gradients_match_differences():
    rules = lm.LanguageRules(shortlist=14, classes=4, state=5)
    rng = np.random.default_rng(1)
    model = lm.Gru(rules, rng.integers(1, 9, 16).astype(float))
    for n in model.NAMES:
        setattr(model, n, rng.standard_normal(getattr(model, n).shape) * 0.5)
    inputs, targets = rng.integers(0, 16, (6, 7)), rng.integers(0, 16, (6, 7))
    keep, live = (rng.random((6, 7)) > 0.2).astype(float), rng.random((6, 7)) > 0.2
    state = rng.standard_normal((7, 5))

    def loss():
        states, _ = model.run(state, inputs, keep)
        return -model.log_likelihood(states.reshape(-1, 5).astype(float), targets.ravel())[live.ravel()].mean()

    states, traces = model.run(state, inputs, keep, trace=True)
    grads = model.gradients(states, traces, inputs, keep, targets, live)
    for n in model.NAMES:
        array = getattr(model, n)
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in array.shape)
            old = array[at]
            array[at] = old + 1e-2
            up = loss()
            array[at] = old - 1e-2
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-2 - grads[n][at]) < 2e-3, n


def test_lanes_do_not_change_scores():
    rules = lm.LanguageRules(shortlist=30, classes=4, state=6)
    rng = np.random.default_rng(2)
    model = lm.Gru(rules, rng.integers(1, 9, 32).astype(float))
    model.of_class, model.of_word = rng.standard_normal(model.of_class.shape).astype(np.float32), rng.standard_normal(model.of_word.shape).astype(np.float32)
    texts = [np.append(rng.integers(1, 32, size=n), 0).astype(np.int32) for n in (0, 1, 5, 200, 33, 64, 31, 7, 90)]
    together = lm.score_chunk(model, texts)
    alone = np.concatenate([lm.score_chunk(model, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-3)
    every = sum(np.exp(model.log_likelihood(np.ones((1, 6), dtype=np.float32), np.array([k])))[0] for k in range(32))
    assert abs(every - 1) < 1e-4


def test_training_learns_an_order():
    rules = lm.LanguageRules(shortlist=8, classes=2, state=8, lanes=32)
    texts = [np.append(np.tile([2, 3, 4, 5], 20), 0).astype(np.int32) for _ in range(400)]
    model = lm.Gru(rules, np.ones(10))
    before = lm.score_chunk(model, texts[:1])[0]
    for _ in range(6):
        lm.train_chunk(model, texts)
    assert lm.score_chunk(model, texts[:1])[0] > before / 3


def test_training_takes_every_step(monkeypatch):
    rules = lm.LanguageRules(shortlist=8, classes=2, state=4, lanes=8)
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(2, 10, size=n), 0).astype(np.int32) for n in (0, 3, 70, 200, 15, 16, 17, 64, 130)]
    taken, plain = [], lm.Gru.gradients

    def counted(self, states, traces, inputs, keep, targets, live):
        taken.append(targets[live])
        return plain(self, states, traces, inputs, keep, targets, live)

    monkeypatch.setattr(lm.Gru, "gradients", counted)
    lm.train_chunk(lm.Gru(rules, np.ones(10)), texts)
    assert np.array_equal(np.sort(np.concatenate(taken)), np.sort(np.concatenate(texts)))


def test_scores_match_a_plain_walk(spark, monkeypatch):
    """Every text by itself, word by word, in 64 bits, with plain counts; the head table holds some of the words only."""
    import zlib

    monkeypatch.setattr(lm, "HEAD", 60)
    rules = lm.LanguageRules(shortlist=20, classes=5, state=6, buckets=7, chunk=1500)
    texts = [prose(k, n) for k, n in enumerate([3, 40, 90, 200, 300, 17, 120, 60, 250, 33])] + ["", None, "unseen qqq zzz THE the", "one"]
    df = documents(spark, texts).unionByName(documents(spark, texts[:3])).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = lm.count_words(df)
    vocab = lm.vocabulary(df, counts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    c, ends = Counter(), 0
    for k, t in rows:
        if lm.is_training(k):
            c.update(plain_words(t))
            ends += 1
    ranked = sorted(c, key=lambda w: (-c[w], w.encode()))
    assert 20 < len(vocab.head) <= 60 and list(vocab.head) == ranked[: len(vocab.head)]
    own = ranked[:20]
    weights = np.random.default_rng(4).standard_normal(len(lm.Gru(rules, np.ones(22)).weights())) * 0.5
    model = lm.Gru(rules, np.ones(22))
    model.load(weights)
    table, gates, cand, of_class, class_bias, of_word, word_bias = (getattr(model, n).astype(float) for n in model.NAMES)
    smoothed = lambda n: n + 0.1
    mass = sum(c.values()) + ends + 0.1 * (len(c) + 1 + 1) - smoothed(ends) - sum(smoothed(c[w]) for w in own)
    log_softmax = lambda x: x - math.log(np.exp(x).sum())
    want = []
    for k, t in rows:
        state, given, total = np.zeros(6), 0, 0.0
        for w in [*plain_words(t), None]:
            target = 0 if w is None else own.index(w) + 2 if w in own else 1
            z, r = np.split(1 / (1 + np.exp(-(table[given][:12] + state @ gates))), 2)
            n = np.tanh(table[given][12:] + (r * state) @ cand)
            state = n + z * (state - n)
            part, place = divmod(target, model.per)
            total += (log_softmax(state @ of_class + class_bias)[part] + log_softmax(state @ of_word[part] + word_bias[part])[place]) / math.log(10)
            if target == 1:
                total += math.log10(smoothed(c[w])) - math.log10(mass)
            given = target if w is None or w in own else 22 + zlib.crc32(w.encode()) % 7
        want.append((k, total))
    found = [(r.doc_id, r.score) for r in lm.score(df, counts, vocab, weights, rules).collect()]
    assert len(found) == len(want)
    for (k, a), (j, b) in zip(sorted(found), sorted(want)):
        assert k == j and abs(a - b) <= 1e-4 * max(1, abs(b)), (k, a, b)
