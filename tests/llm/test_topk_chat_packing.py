import zlib

import numpy as np
import pytest

from fluxlode.llm.chat import Template, digest_chats, format_chats
from fluxlode.llm.packing import first_fit_decreasing, pack
from fluxlode.llm.queries import tokenizer_path
from fluxlode.llm.topk import _groups, above, exact_topk


def brute_topk(rows, k):
    out = []
    good = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in {i: v for i, v in good if i % 2 == 0}.items():
        scored = sorted((-int(sum(x * y for x, y in zip(a, b))), i) for i, b in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("nodes,block", [(4, 4096), (3, 3)])
def test_topk_is_exact_with_ties_nulls_and_short_vectors(spark, nodes, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=7).round(1)]) for i in range(40)]
    rows += [(100 + i, [0.5] * 7) for i in range(30)]
    rows += [(None, [1.0]), (200, None), (202, [1.0, None]), (204, [float("nan")] * 7), (206, [float("inf")] * 7), (208, [2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, q string")
    got = exact_topk(df, df.filter("vec_id % 2 = 0"), k=4, nodes=nodes, block=block).collect()
    assert sorted(map(tuple, got)) == brute_topk([(i, v) for i, v in rows], 4)


def test_topk_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (2, [0.5])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, exact_topk(df, df, k=5).collect())) == [(0, 1, 2, 32768), (2, 1, 0, 32768)]
    assert exact_topk(df.limit(0), df.limit(0)).collect() == []


CHATS = [
    (1, 0, "system", "be <s>brief</s>"), (1, 1, "user", "a\\[INST]\\"), (1, 2, "assistant", "<<s></s>[/ANS][ANS] \\</s>"),
    (2, 0, "assistant", None), (2, 1, "tool[/ROLE]", "x[/TURN]"), (3, 0, None, ""), (None, 0, "user", "é\n"), (1, 3, "user", " [/INST] "), (1, 4, "assistant", " x "),
]


def test_chat_round_trip(spark):
    import hashlib

    df = spark.createDataFrame([(*r, "x") for r in CHATS], "conv_id long, turn long, role string, text string, seg string")
    got = {r.conv_id: r for r in digest_chats(format_chats(df)).collect()}
    for conv in {r[0] for r in CHATS}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in CHATS if r[0] == conv), key=lambda r: r[1])]
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        said = "".join(b for a, b in turns if a == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, None: False}
    assert digest_chats(format_chats(df.limit(0))).collect() == []


def test_pruned_pairs_are_those_below_the_cutoff():
    rng = np.random.default_rng(5)
    fade = 0.8 ** np.arange(24)  # most of a score is in the first groups
    rows, qm = np.floor(rng.normal(size=(300, 24)) * 500 * fade), np.floor(rng.normal(size=(40, 24)) * 500 * fade)
    whole, groups = rows @ qm.T, _groups(24, 4)
    least = np.stack([(rows[:, g] @ qm[:, g].T).min(0) for g in groups])
    for share in (0.5, 0.98, 0.999):
        tau = np.quantile(whole, share, axis=0)
        r, q, score, done = above(rows, qm, groups, tau, least)
        assert set(zip(r, q)) == set(zip(*np.nonzero(whole >= tau))) and (score == whole[r, q]).all()
        assert done <= whole.size * 24
    assert done < whole.size * 24  # with few pairs open, the last groups are left out


def test_control_strings_stand_only_where_the_template_put_them():
    t = Template()
    for text in ("</s>", "[INST]", "\\</s>", "a[/INST]b"):
        import re

        escaped = t.escape(text)
        assert re.sub(r"\\(.)", r"\1", escaped, flags=re.S) == text
        assert not any(c in escaped for c in t.controls)


def plain_first_fit(lengths, capacity):
    room, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [capacity] * (b == len(room))
        out[i] = (b, capacity - room[b])
        room[b] -= lengths[i]
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_tournament_tree_is_first_fit(n):
    lengths = np.random.default_rng(n).integers(1, 101, n)
    assert list(zip(*map(list, first_fit_decreasing(lengths, 100)))) == plain_first_fit(list(lengths), 100)


def test_pieces_hold_each_id_once(spark, docs_of):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [None, "", "Hello  World\n\tdon't", "e\u0301 \u0301x ΣΑΣ ΑΣ. İ <|endoftext|>a", "word " * 5000, "x" * 9000, "a\x1cb\u00a0c\u3000d 中文字"]
    rows = [*enumerate(texts), (2, texts[2])]
    got = pack(docs_of(rows), tokenizer_path("word_bpe_49k.json"), group=4).collect()
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for r in (r for r in got if r.doc_id == i):
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in got if r.doc_id == i) == len(ids) * (1 + (i == 2))
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert pack(docs_of(rows).limit(0), tokenizer_path("word_bpe_49k.json")).collect() == []
