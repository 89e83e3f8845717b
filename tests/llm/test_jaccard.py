import re

import numpy as np
import pytest

from fluxlode.llm.components import components
from fluxlode.llm.jaccard import jaccard_components


def brute(rows, num=90, den=100):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                label = [label[j] if x == label[i] else x for x in label]
    ids = [min(rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None) if rows[i][0] is not None else None for i in range(len(rows))]
    return sorted(((r[0] if r[0] is not None else -1), len(s), c if c is not None else -1) for r, s, c in zip(rows, sets, ids))


def family(rng, base, copies, changes):
    out = []
    for _ in range(copies):
        w = list(base)
        for at in rng.integers(0, len(w), rng.integers(0, changes + 1)):
            w[at] = f"x{rng.integers(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk,most,num,hot", [(512, 2_000_000, 90, 1000), (6, 2_000_000, 90, 6), (12, 2_000_000, 80, 15), (512, 900, 80, 1000)])
def test_components_equal_brute_force(spark, docs_of, monkeypatch, chunk, most, num, hot):
    monkeypatch.setattr("fluxlode.llm.jaccard.HOT", hot)
    monkeypatch.setattr("fluxlode.llm.jaccard.SAMPLE", 1)
    monkeypatch.setattr("fluxlode.llm.jaccard.PAIRS", 1000)
    rng = np.random.default_rng(3)
    texts = [None, "", "  \n", "one", "ONE", "one two", "one  two", "a b c", "A b\tc", "a b c d"]
    for size, copies, changes in ((9, 6, 1), (12, 10, 1), (30, 12, 2), (90, 30, 6), (200, 25, 9)):
        texts += family(rng, [f"w{x}" for x in rng.integers(0, 5000, size)], copies, changes)
    shared = [f"s{x}" for x in range(40)]  # a passage of many documents, which links none of them
    for i in range(25):
        own = [f"o{i}x{x}" for x in range(30)]
        texts += family(rng, own + shared, 1 + i % 2, 2)
    w = [f"v{x}" for x in range(60)]
    texts += [" ".join(w[:n]) for n in range(40, 61)]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    rows += [(rows[5][0], "another text of a repeated id"), (rows[40][0], rows[40][1]), (None, "one")]
    got = jaccard_components(docs_of(rows), num=num, chunk=chunk, most=most).collect()
    expected = brute([r for r in rows if r[0] is not None], num)
    assert sorted(tuple(r)[:3] for r in got if r.doc_id is not None) == expected
    assert [tuple(r)[:3] for r in got if r.doc_id is None] == [(None, 1, None)]


def test_no_rows(spark, docs_of):
    assert jaccard_components(docs_of([(1, "a")]).limit(0)).collect() == []


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1100)] + [(2000, 2000), (3001, 3000), (3000, 3001)]
    links = spark.createDataFrame(links, "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == dict(map(tuple, components(links, few=10).collect()))
    assert got == {**{i: 0 for i in range(51)}, **{i: 1000 for i in range(1000, 1100)}, 3000: 3000, 3001: 3000}
