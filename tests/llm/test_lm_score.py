import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fluxlode.llm.lm_score import Lexicon, fitted, score_documents, tokens
from fluxlode.llm.recurrent import Model, classes_of, lay_out, sums


def small(hidden=5, seed=1):
    model = Model(np.array([0, 1, 4, 9]), hidden, seed)
    model.p = {k: (v + np.random.default_rng(9).normal(size=v.shape) * 0.5).astype(np.float64) for k, v in model.p.items()}
    return model


def test_gradients_equal_finite_differences():
    model, rng = small(), np.random.default_rng(0)
    texts = [rng.integers(0, 10, n) for n in (7, 5, 3, 2)]
    x, y, start, _ = lay_out(texts, 2, 10)
    h = np.zeros((2, 5))
    _, grads, _ = model.gradients(x, y, start, h)
    rows, values = grads["x"]
    grads["x"] = np.zeros_like(model.p["x"])
    grads["x"][rows] = values
    for name, value in model.p.items():
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(6)]:
            was = value[at]
            value[at] = was + 1e-4
            up = model.gradients(x, y, start, h)[0]
            value[at] = was - 1e-4
            down = model.gradients(x, y, start, h)[0]
            value[at] = was
            assert grads[name][at] == pytest.approx((up - down) / 2e-4, rel=5e-3, abs=2e-3)  # states are float32


def test_words_probabilities_sum_to_one_and_windows_carry_the_state():
    model = small()
    h = np.random.default_rng(3).normal(size=(1, 5))
    assert sum(np.exp(model.log_prob(h, np.array([w]))[0][0]) for w in range(10)) == pytest.approx(1)
    texts = [np.random.default_rng(n).integers(0, 10, n) for n in (50, 1, 9, 30, 30)]
    plain = []
    for t in texts:
        h, total = np.zeros((1, 5)), 0.0
        for before, now in zip([10, *t[:-1]], t):
            _, h, _ = model.steps(np.array([[before]]), np.array([[False]]), h)
            total += model.log_prob(h, np.array([now]))[0][0]
        plain.append(total)
    for lanes, window in ((1, 4), (3, 7), (256, 1000)):
        assert np.allclose(model.score(texts, lanes, window), plain, atol=1e-3)


def test_classes_ask_for_few_columns_a_token():
    """A token costs a column for each class and for each word of its own class; equal shares in 90 classes ask for 163 of these."""
    counts = 1e7 / np.arange(1, 8193)
    bounds = classes_of(counts)
    size = np.diff(bounds)
    share = np.add.reduceat(counts, bounds[:-1]) / counts.sum()
    assert bounds[0] == 0 and bounds[-1] == 8192 and size.min() > 0
    assert len(size) + (size * share).sum() < 140


def test_probabilities_of_far_logits_and_of_many_tokens():
    model, rng = small(), np.random.default_rng(5)
    for by in (1, 60):  # 60: exponentials would overflow float32
        for k in ("c", "cb", "w", "wb"):
            model.p[k] = (model.p[k] * by).astype(np.float32)
        h, y = rng.normal(size=(2500, 5)).astype(np.float32), rng.integers(0, 10, 2500)
        p = {k: v.astype(float) for k, v in model.p.items()}
        own = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
        got = model.log_prob(h, y)[0]
        for i in rng.integers(0, 2500, 200):
            k = model.word_class[y[i]]
            want = own(h[i] @ p["c"] + p["cb"])[k]
            if k < 3:
                lo, hi = model.bounds[k : k + 2]
                want += own(p["w"][lo:hi] @ h[i] + p["wb"][lo:hi])[y[i] - lo]
            assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_runs_of_any_length_are_summed():
    rng = np.random.default_rng(7)
    size = np.r_[rng.integers(1, 12, 200), 300]
    bounds = np.r_[0, np.cumsum(size)]
    rows = rng.normal(size=(bounds[-1], 6))
    assert np.allclose(sums(rows, bounds), np.add.reduceat(rows, bounds[:-1]))


def test_words_that_share_a_slot_are_told_apart(monkeypatch):
    monkeypatch.setattr("fluxlode.llm.lm_score.SLOTS", 4)
    rng = np.random.default_rng(2)
    token = rng.integers(0, 2**63, 300).astype(np.uint64)
    count = rng.integers(1, 1000, 300)
    lexicon = Lexicon(token, count, 20, int(count.sum()) + 9, 309)
    here, share, number = lexicon.look_up(np.r_[token, token + np.uint64(1)])
    assert here[:300].all() and not here[300:].any()
    assert np.allclose(share, np.r_[np.log10(count + 1.0), np.zeros(300)])
    rank = np.lexsort((token, -count))
    assert number[rank[:20]].tolist() == list(range(20)) and (number[300:] == lexicon.last).all()


def test_training_learns_an_order():
    texts = [np.array([0, 1, 2, 3] * 10 + [4]) for _ in range(60)]
    model = Model(classes_of(np.array([10, 10, 10, 10, 1])), 8)
    before = model.score(texts[:5]).sum()
    model.fit(texts, lanes=4, window=8, passes=3)
    assert model.score(texts[:5]).sum() > before / 3


def test_scores_equal_brute_force_counts(spark, docs_of):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"W{x}" for x in rng.zipf(1.5, 30) % 50)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "unseen words here"), (203, " ".join(f"W{x}" for x in rng.zipf(1.5, 30000) % 50)), (5, rows[5][1]), (None, "w1")]
    df = docs_of(rows)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</end>"]
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not out(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    for known, head in ((500_000, 4000), (10, 6)):
        got = score_documents(df, known=known, head=head).collect()
        assert len(got) == len(rows)
        by = {(r.doc_id, r.n_tokens): r for r in got}
        for i, t in rows:
            w = split(t)
            r = by[i, len(w)]
            assert (r.held_out, r.n_known, r.train_tokens) == (out(i), sum(counts[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
            assert r.score < 0
        held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
        assert sum(r.score for r in held) > sum(r.base_score for r in held) * 1.15  # independent words: there is nothing to gain
    assert score_documents(df.limit(0)).collect() == []


def test_weights_take_every_training_document(spark, docs_of):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 5 + i % 40) % 300)) for i in range(400)]
    train = docs_of(rows).select("doc_id", "text").repartition(3)
    words, times = np.unique(np.concatenate([tokens(pa.array([t]))[0] for _, t in rows]), return_counts=True)
    total = int(times.sum())
    top = times >= 2  # the others are not broadcast
    lexicon = Lexicon(words[top], times[top], 10, total, len(words))
    model, saw = fitted(train, spark.sparkContext.broadcast(lexicon), first_docs=5, first_tokens=50)
    assert saw == total
    texts = [lexicon.look_up(tokens(pa.array([t]))[0])[2] for _, t in rows]
    assert model.score(texts).sum() > lexicon.model().score(texts).sum()


def test_bands_hold_every_word_once():
    rng = np.random.default_rng(8)
    token, count = np.arange(1000, dtype=np.uint64) * np.uint64(77), rng.zipf(1.3, 1000).clip(1, 10**6)
    lexicon = Lexicon(token, count, 20, int(count.sum()) + 50, 1050)
    number = lexicon.look_up(token)[2]
    share = np.zeros(lexicon.last + 1)
    np.add.at(share, number, count + 1.0)
    assert len(lexicon.band_counts) > 3 and np.all(share[20:-1] == lexicon.band_counts + lexicon.band_sizes)
    assert share[-1] + 100 == lexicon.other_count + lexicon.other_size
    assert lexicon.look_up(np.array([5], np.uint64))[2] == lexicon.last


def test_score_is_class_times_word_times_share(spark, docs_of, monkeypatch):
    """Each token by its own formula, with the gates written out, for a model whose weights are given."""
    from fluxlode.llm import lm_score

    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 25) % 60)) for i in range(60)] + [(500, "never seen w1"), (501, None)]
    given = {}

    def frozen(train, lexicon, *_):
        model = lexicon.value.model()
        noise = np.random.default_rng(2)
        for k in ("x", "u", "c", "w"):
            model.p[k] = (model.p[k] + noise.normal(size=model.p[k].shape) * 0.3).astype(np.float32)
        given.update(model=model, lexicon=lexicon.value)
        return model, 0

    monkeypatch.setattr(lm_score, "fitted", frozen)
    got = {r.doc_id: r.score for r in score_documents(docs_of(rows), head=12).collect()}
    model, lex = given["model"], given["lexicon"]
    p, n, bounds = {k: v.astype(float) for k, v in model.p.items()}, model.hidden, model.bounds
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</end>"]
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
    sizes = {}
    for w, c in train.items():
        number = int(lex.look_up(tokens(pa.array([w if w != "</end>" else ""]))[0][:1])[2][0])
        sizes.setdefault(number, []).append(c + 1)
    for i, t in rows:
        token = tokens(pa.array([t]))[0]
        number, h, total, before = lex.look_up(token)[2], np.zeros(n), 0.0, int(bounds[-1]) + 1
        for w, y in zip(split(t), number):
            a, g = p["x"][before], h @ p["u"]
            z, r = sigmoid(a[:n] + g[:n]), sigmoid(a[n : 2 * n] + g[n : 2 * n])
            c = np.tanh(a[2 * n :] + r * g[2 * n :])
            h = (1 - z) * c + z * h
            k = int(model.word_class[y])
            total += math.log10(soft(h @ p["c"] + p["cb"])[k])
            if k < len(bounds) - 1:
                lo, hi = bounds[k], bounds[k + 1]
                total += math.log10(soft(p["w"][lo:hi] @ h + p["wb"][lo:hi])[y - lo])
            if y >= lex.head:
                total += math.log10((train[w] + 1) / (sum(sizes.get(int(y), [])) + (1 if y == lex.last else 0)))
            before = int(y)
        assert got[i] == pytest.approx(total, abs=2e-3), i
