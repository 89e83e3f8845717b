import zlib

import numpy as np
import pyarrow as pa
import pytest

from fluxlode.llm.langid import expected, forward, forward_long, identify_languages, vocabulary, word_scores
from fluxlode.llm.queries import tokenizer_path
from fluxlode.llm.words import words

PATH = tokenizer_path("piece_bpe_32k.model")


def segmentations(text, pieces):
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            for rest in segmentations(text[n:], pieces):
                yield (pieces[text[:n]], *rest)


@pytest.mark.parametrize("word", [b" the", b" anther", "été".encode(), b" x\xc3", b" zzqz"])
def test_forward_and_expected_counts_sum_all_segmentations(word):
    vocab = vocabulary(PATH)
    pieces = {p: i for i, p in enumerate(vocab.pieces)}
    prob = np.random.default_rng(2).random((len(pieces), 2)) / len(pieces)
    matrix = np.frombuffer(word, np.uint8)[None]
    ways = list(segmentations(word, pieces))
    total = [sum(np.prod(prob[list(x), k]) for x in ways) for k in range(2)]
    assert np.allclose(forward(matrix, vocab, prob)[0], np.log(total))
    counts = np.zeros(len(pieces))
    for x in ways:
        for i in x:
            counts[i] += 3 * np.prod(prob[list(x), 1]) / total[1]
    assert np.allclose(expected(matrix, np.array([3.0]), vocab, prob[:, 1]), counts)


def plain_forward(word, pieces, prob, longest):
    """Log probability in steps of one byte, in logarithms."""
    alpha = [0.0] + [-np.inf] * len(word)
    for j in range(1, len(word) + 1):
        terms = [alpha[i] + np.log(prob[pieces[word[i:j]]]) for i in range(max(0, j - longest), j) if word[i:j] in pieces]
        alpha[j] = np.logaddexp.reduce(terms)
    return alpha[-1]


def test_long_words_are_scored_whole():
    vocab = vocabulary(PATH)
    pieces = {p: i for i, p in enumerate(vocab.pieces)}
    assert vocab.longest == max(map(len, pieces)) > 16
    rng = np.random.default_rng(3)
    prob = rng.random((len(pieces), 2)) / len(pieces)
    long = "".join(rng.choice(["tion", "heit", "and", "\u4e2d\u6587", "\u00e9", "q", "ation"], 90)).encode()
    for word in (b" internationalization", b" " + long[:299], b" " + long):
        expect = [plain_forward(word, pieces, prob[:, k], vocab.longest) for k in range(2)]
        row = np.frombuffer(word, np.uint8)
        assert np.allclose(forward(row[None], vocab, prob)[0], expect)
        assert np.allclose(forward_long(row, vocab, prob), expect)
        assert np.allclose(forward_long(row, vocab, prob, block=50), expect)
        w = words(pa.array([word.decode(errors="replace")[1:]]))
        assert len(w.first) == 1 and word_scores(w.data, w.first, w.last, vocab, prob).shape == (1, 2)


def test_expected_counts_of_a_long_run_agree_with_the_gradient():
    vocab = vocabulary(PATH)
    prob = np.random.default_rng(4).random(len(vocab.pieces)) / len(vocab.pieces)
    word = np.frombuffer((" " + "thenationand" * 20).encode(), np.uint8)[None]
    counts = expected(word, np.ones(1), vocab, prob)
    assert np.isclose((counts * [len(p) for p in vocab.pieces]).sum(), word.shape[1])
    for i in np.argsort(-counts)[:5]:  # d log P / d log p is the expected count
        up = prob.copy()
        up[i] *= 1 + 1e-6
        assert np.isclose((forward(word, vocab, up[:, None]) - forward(word, vocab, prob[:, None]))[0, 0] / np.log1p(1e-6), counts[i], rtol=1e-3)


def test_words_longer_than_a_block_hash_alike(monkeypatch):
    texts = pa.array(["ab " + "xyz" * 700 + " c", "y" * 48])
    whole = words(texts).hash
    monkeypatch.setattr("fluxlode.llm.words.BLOCK", 100)
    monkeypatch.setattr("fluxlode.llm.words._STATE", {})
    assert (words(texts).hash == whole).all()


def test_held_out_accuracy_and_edges(spark, docs_of):
    rng = np.random.default_rng(0)
    kinds = {"aa": ["the", "and", "with", "from", "nation"], "bb": ["der", "und", "nicht", "heit", "keit"], "cc": ["que", "les", "dans", "tion", "eaux"]}
    rows = [(i, " ".join(rng.choice(kinds[x], 12)), x, 1) for i, x in zip(range(300), list(kinds) * 100)]
    rows += [(1000, None, "aa", 1), (1001, "", "aa", 1), (1002, "12 !?", None, 1), (None, "der und nicht", None, 1), (1003, "der und " * 40000, None, 1), (5, "the and with from", "aa", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, row long")
    got = identify_languages(df, PATH).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert len(held) > 30 and all(r.lang_pred == list(kinds)[r.doc_id % 3] for r in held if r.doc_id != 5)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[None].lang_pred == by[1003].lang_pred == "bb"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    plain = df.withColumn("lang", df.lang.substr(9, 1)).filter("false")
    assert identify_languages(plain, PATH).collect() == []
    assert {r.lang_pred for r in identify_languages(df.filter("lang is null"), PATH).collect()} == {"und"}


def test_predictions_equal_a_plain_fit(spark):
    """The query's own settings: two rounds of expectation maximisation over all learned documents, then the forward sums."""
    vocab = vocabulary(PATH)
    pieces = {p: i for i, p in enumerate(vocab.pieces)}
    kinds = {"aa": ["the", "Nation"], "bb": ["der", "nicht"]}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(kinds[x], 6)), x) for i, x in zip(range(24), list(kinds) * 12)]
    learn = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 5]
    prob = np.full((len(pieces), 2), 1 / len(pieces))
    cut = lambda t: [b" " + w.lower().encode() for w in t.split()]
    for _ in range(2):
        count = np.zeros_like(prob)
        for text, lang in learn:
            k = list(kinds).index(lang)
            for w in cut(text):
                ways = list(segmentations(w, pieces))
                weight = np.array([np.prod(prob[list(x), k]) for x in ways])
                for x, share in zip(ways, weight / weight.sum()):
                    for i in x:
                        count[i, k] += share
        prob = count + 20 * (count / count.sum(0)).mean(1, keepdims=True) + 0.01
        prob /= prob.sum(0)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in identify_languages(df, PATH).collect():
        total = np.array([sum(plain_forward(w, pieces, prob[:, k], vocab.longest) for w in cut(rows[r.doc_id][1])) for k in range(2)])
        assert r.lang_pred == list(kinds)[int(total.argmax())]
        assert r.score == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-6)
