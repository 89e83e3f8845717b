import re

import numpy as np
import pytest

from fluxlode.llm.fm_index import FMIndex
from fluxlode.llm.substring_dedup import dedup_substrings, later_windows


def brute(rows, window):
    seen, out = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone |= set(range(a, a + window))
            seen.setdefault(k, (i, a))
        out[i, text] = (len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone))
    return sorted(((r[0] if r[0] is not None else -1), *out[r]) for r in rows)


def test_backward_search_finds_all_repeats():
    rng = np.random.default_rng(1)
    symbols = np.r_[rng.integers(1, 5, 500), 0].astype(np.uint8)
    symbols[300:340] = symbols[100:140]
    starts = np.arange(480)
    plain = [s for s in starts if sum(symbols[a : a + 9].tobytes() == symbols[s : s + 9].tobytes() for a in range(492)) > 1]
    assert sorted(FMIndex(symbols).repeated(symbols, starts, 9)[0]) == plain
    index, c, i = FMIndex(symbols), np.array([1, 2, 3, 4]), np.array([7, 100, 499, 501])
    padded = symbols.tobytes() + bytes(32)
    bwt = symbols[np.array(sorted(range(len(symbols)), key=lambda k: (padded[k : k + 32], k))) - 1]
    assert not hasattr(index, "suffix")
    assert list(index.rank(c, i)) == [int((bwt[:b] == a).sum()) for a, b in zip(c, i)]


def test_later_windows_are_exact_where_symbols_agree():
    same = np.arange(1, 60, dtype=np.uint64)
    assert list(later_windows([same[:30], same[10:40]], 5)) == [31 + i for i in range(16)]
    assert not len(later_windows([same], 5))


@pytest.mark.parametrize("hot,shard_words", [(1000, 1_500_000), (3, 200)])
def test_equals_brute_force(spark, docs_of, hot, shard_words):
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    passage = word(35)
    rows = [(0, None), (1, ""), (2, " ".join(word(19))), (3, "a " * 50), (4, "é x " * 30)]
    for i in range(10, 40):
        w = word(int(rng.integers(0, 60)))
        w += passage[: int(rng.integers(15, 36))] + word(int(rng.integers(0, 30)))
        if i % 7 == 0:
            w = w + w
        rows.append((i * 13 % 101 + 5, "  ".join(w)))
    rows += [(300 + n, rows[8][1]) for n in range(3)] + [(400, rows[2][1]), (rows[9][0], rows[9][1]), (500, "\n".join(word(3000) + passage)), (None, rows[12][1])]
    got = dedup_substrings(docs_of(rows), hot=hot, shard_words=shard_words).collect()
    assert sorted(((r[0] if r[0] is not None else -1), *r[1:]) for r in map(tuple, got)) == brute(rows, 20)
    assert dedup_substrings(docs_of(rows).limit(0)).collect() == []
