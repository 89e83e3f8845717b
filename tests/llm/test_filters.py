import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from fluxlode.llm.decontaminate import MASKS, SHORT, contaminated, decontaminate
from fluxlode.llm.line_dedup import dedup_lines
from fluxlode.llm.quality import Resampling, cutoff, gumbel, kth


def brute_lines(rows, min_docs, short_docs=20):
    def keys(line):
        w = ["<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
        if len(w) < 3:
            return {(".", *w)} if w else set()
        if len(w) < 8:
            return {("=", *w)}
        cut = 3 + (len(w) - 2) // 2
        return {("<", len(w), *w[:cut]), (">", len(w), *w[:3], "|", *w[cut:])}

    seen = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        for k in {k for line in (text or "").split("\n") for k in keys(line)}:
            seen[k].append(i)
    often = {k: min(x for x in ids if x is not None) for k, ids in seen.items() if len(ids) >= (short_docs if k[0] == "." else min_docs)}
    out = []
    for i, text in rows:
        lines = text.split("\n") if text else []
        kept = [x for x in lines if not any(k in often and (i is None or i > often[k]) for k in keys(x))]
        out.append((i, "\n".join(kept) if text else text, len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_equals_brute_force(spark, docs_of):
    body = "the quick brown fox jumps over the lazy dog again"
    rows = [(i, f"own line {'abcdefgh'[i]}x\nsigned in at 12:{i:02d} by user{i}\n{body}\n\n  \nshort x") for i in range(8)]
    rows += [(i, f"user ann has read page {w} of the book today\nagain and\nagain and") for i, w in zip(range(20, 26), "abcdef")]
    rows += [(30, None), (31, ""), (32, "\n"), (33, "\n\n" + body), (None, body), (3, rows[3][1]), (34, body + "\r\n" + body), (35, "x " * 50000 + "\n" + body)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs_of(rows), min_docs=4).collect()]
    assert sorted(got, key=key) == sorted(brute_lines(rows, 4), key=key)
    short = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs_of(rows), min_docs=4, short_docs=6).collect()]
    assert sorted(short, key=key) == sorted(brute_lines(rows, 4, 6), key=key) and sum(r[3] for r in short) > sum(r[3] for r in got)
    assert sum(r[3] for r in got) > 20
    assert dedup_lines(docs_of(rows), min_docs=4).columns == ["doc_id", "text", "lang", "source", "n_chars", "hash", "n_lines", "n_removed"]
    assert dedup_lines(docs_of(rows).limit(0)).collect() == []
    clash = docs_of(rows).withColumnRenamed("hash", "gone").withColumnRenamed("lang", "line").withColumnRenamed("source", "key")
    assert dedup_lines(clash, min_docs=4).columns[:6] == clash.columns and dedup_lines(clash, min_docs=4).count() == len(rows)


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_leaks(docs, items, window=20, share=0.8):
    """Every passage at every place, without masks."""
    best = {}
    for d, text in docs:
        a = split(text)
        for t, itext in items:
            b = split(itext)
            need = min(len(b), window)
            for p in range(len(a) - need + 1 if need else 0):
                for j in range(len(b) - need + 1):
                    if (m := sum(a[p + i] == b[j + i] for i in range(need))) >= np.ceil(need * share):
                        best[d, t] = max(best.get((d, t), (0, 0)), (m, need))
    return sorted((*k, *v) for k, v in best.items())


def test_masks_see_every_pattern_of_substitutions():
    from itertools import combinations

    marks = [[i for i, bit in enumerate(m) if bit == "1"] for m in MASKS]
    for n in range(SHORT, 21):
        for gone in combinations(range(n), n - int(np.ceil(0.8 * n))):
            assert any(not set(gone) & {o + i for i in m} for m in marks for o in range(n - len(MASKS[0]) + 1)), (n, gone)


@pytest.mark.parametrize("rows", ["broadcast", "shuffle"])
def test_decontamination_equals_brute_force(spark, docs_of, monkeypatch, rows):
    if rows == "shuffle":
        monkeypatch.setattr("fluxlode.llm.decontaminate.BROADCAST_ROWS", 0)
    monkeypatch.setattr("fluxlode.llm.decontaminate.PIECE", 16)
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    items = [(0, " ".join(word(40))), (1, " ".join(word(14))), (2, " ".join(word(9))), (3, None), (4, " ".join(word(90))), (5, "")]
    docs = [(0, None), (1, ""), (2, "a b"), (3, " ".join(word(50)))]
    for n in range(30):
        t, text = items[[0, 1, 4][n % 3]]
        w = text.split()
        part = w if n % 2 else w[: max(10, len(w) // 2)]
        for at in rng.integers(0, len(part), n % 8):
            part[at] = "changed"
        docs.append((10 + n, " ".join(word(int(rng.integers(0, 60)))) + " " + ", ".join(part).upper() + ". " + " ".join(word(20))))
    df = docs_of([*docs, (None, docs[10][1]), docs[11]])
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, seed int")
    expected = brute_leaks(docs, items)
    assert sorted(map(tuple, contaminated(df, bench).collect())) == expected
    assert 10 < len(expected) < 30
    kept = decontaminate(df, bench).collect()
    assert Counter(r.doc_id for r in kept) == Counter(i for i in [d for d, _ in docs] + [None, docs[11][0]] if i not in {e[0] for e in expected})
    assert contaminated(df.limit(0), bench).collect() == [] == contaminated(df, bench.limit(0)).collect()


def corpus(spark, docs_of, n=600):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [f"w{int(x)}" for x in rng.zipf(1.3, 120) % 500]
        if bad:
            w = [x if rng.random() < 0.7 else "junk$$" for x in w]
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    return rows, docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_resampling_keeps_good_and_drops_bad_held_out_documents(spark, docs_of):
    rows, docs, labels = corpus(spark, docs_of)
    fit = Resampling(docs, labels)
    kept = {r.doc_id for r in fit.selected().collect()}
    held = [i for i, _ in rows if i % 3 == 0]
    assert np.mean([(i in kept) == (i % 4 != 0) for i in held]) > 0.95
    assert len(kept) == fit.k
    whole = fit.documents().collect()
    assert {r.doc_id for r in whole} == kept and len(whole) == len(kept)
    assert fit.documents().columns == docs.columns
    scores = {r.doc_id: r.key for r in fit.scores.collect()}
    assert kept == set(sorted(scores, key=lambda i: (-scores[i], i))[: fit.k])


def test_weights_equal_a_plain_computation(spark, docs_of):
    rows = [(1, "aa bb aa"), (2, "aa cc"), (3, "cc cc cc dd"), (4, None), (5, ""), (6, "aa bb")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    fit = Resampling(docs_of(rows), labels, prior=1.0, zone=0.0)
    grams = {i: Counter((t or "").split()) + Counter({"*": 1} if "cc cc cc" in (t or "") else {}) for i, t in rows}
    raw, good = sum(grams.values(), Counter()), grams[1] + grams[2]
    n, g = sum(raw.values()), sum(good.values())
    got = {r.doc_id: r.log_weight for r in fit.scores.collect()}
    ratio = sorted((np.log((good[w] + 1) / (raw[w] * g / n + 1)), good[w]) for w in raw)
    mass = np.cumsum([c for _, c in ratio])
    centre = ratio[int(np.searchsorted(mass, mass[-1] / 2))][0]
    for i, c in grams.items():
        own, known = sum(c.values()), i in (1, 2)
        share = (g - own * known) / (n - own)
        expected = sum(t * (np.log((good[w] - t * known + 1) / ((raw[w] - t) * share + 1)) - centre) for w, t in c.items())
        assert got[i] == pytest.approx(expected, abs=1e-9)


def test_resampling_edges(spark, docs_of):
    rows, docs, labels = corpus(spark, docs_of, 40)
    assert Resampling(docs, labels.limit(0)).selected().count() == 40
    assert Resampling(docs.limit(0), labels).documents().collect() == []
    odd = docs_of([(None, "w1"), (1, None), (2, ""), (2, "w1 w2"), (3, "junk$$ " * 5000)])
    assert Resampling(odd, labels).selected().count() <= 5
    extra = docs.withColumnRenamed("hash", "good")
    assert Resampling(extra, labels).documents().columns == extra.columns


def test_kth_and_cutoff(spark):
    values = [3.5, 1.0, 1.0, 1.0, 7.25, -2.0, 1e-9, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [kth(df, "x", k, bins=3) for k in range(1, 9)] == sorted(values, reverse=True)
    assert cutoff(np.array([0, 0, 1, 1]), np.array([-3.0, -2.0, -1.0, 0.0])) == -1.5
    assert cutoff(np.array([1, 1]), np.array([1.0, 2.0])) == -np.inf
    assert np.isfinite(gumbel(np.arange(1000), 1)).all()


def test_short_items_are_found_with_every_pattern_of_changes(spark, docs_of):
    sizes = (1, 2, 3, 4, 5, 7, 9, 10, 11, 14)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in sizes]
    docs, expected, doc = [], [], 0
    for n, text in items:
        free = n - int(np.ceil(n * 0.8))
        for changes in range(free + 2):
            for places in combinations(range(n), changes):
                w = ["other" if k in places else x for k, x in enumerate(text.split())]
                docs.append((doc, " ".join(w) if doc % 2 else "before it " + " ".join(w) + " after it"))
                if changes <= free:
                    expected.append((doc, n, n - changes, n))
                doc += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, contaminated(docs_of(docs), bench).collect())) == expected


def test_cutoff_counts_every_labelled_document():
    good, weight, times = np.array([0, 0, 1, 1]), np.array([-1.0, 0.0, 0.0, 1.0]), np.array([1, 10, 1, 10])
    assert cutoff(good, weight, times) == 0.5 == cutoff(np.repeat(good, times), np.repeat(weight, times))


def test_weights_of_the_querys_own_settings_equal_a_plain_computation(spark, docs_of):
    """The zone, the prior, words cut at marks and words' first bytes, as op2_quality uses them."""
    rng = np.random.default_rng(3)
    good_words, bad_words = ["Wonderful,", "evening", "sailing;boats", "harbour", "quiet"], ["cheapest!!!", "pills", "clickhere", "Casino.", "winner"]
    rows = [(i, " ".join(rng.choice(good_words if i % 2 else bad_words, 60)) + (" spam spam spam" if i % 5 == 0 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    fit = Resampling(docs_of(rows), labels)

    def grams(text):
        words_ = re.findall(r"[a-z]+|[^a-z\s]+", text.lower())
        out = Counter(("w", w) for w in words_)
        for n in (4, 5):
            out += Counter((n, w[:n]) for w in words_ if len(w) >= n)
        return out + Counter({"thrice": sum(a == b == c for a, b, c in zip(words_, words_[1:], words_[2:]))})

    own = {i: grams(x) for i, x in rows}
    raw, good = sum(own.values(), Counter()), sum((own[i] for i in range(60) if i % 2), Counter())
    n, g, prior, zone = sum(raw.values()), sum(good.values()), 5.0, 1.4
    ratio = sorted((np.log((good[w] + prior) / (raw[w] * g / n + prior)), good[w]) for w in raw)
    mass = np.cumsum([c for _, c in ratio])
    centre = ratio[int(np.searchsorted(mass, mass[-1] / 2))][0]
    got = {r.doc_id: r.log_weight for r in fit.scores.collect()}
    for i, c in own.items():
        known, size = i < 60 and i % 2 == 1, sum(c.values())
        share, expected = (g - size * known) / (n - size), 0.0
        for w, times in c.items():
            r = np.log((good[w] - times * known + prior) / ((raw[w] - times) * share + prior)) - centre
            expected += times * np.sign(r) * max(abs(r) - zone, 0)
        assert got[i] == pytest.approx(expected, abs=1e-6)
    kept = {r.doc_id for r in fit.selected().collect()}
    assert all((i in kept) == (i % 2 == 1) for i, _ in rows)
