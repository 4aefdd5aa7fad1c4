"""Alignment of two tokenizers against a brute-force version."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from parcelwatch.llm import align

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


@pytest.fixture(scope="module")
def both():
    return align.byte_level(f"{align.FOLDER}/{align.BYTE_LEVEL}"), align.pieces(f"{align.FOLDER}/{align.PIECES}")


@pytest.fixture(scope="module")
def libraries():
    """The two public libraries that read the files, used plainly."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(f"{align.FOLDER}/{align.BYTE_LEVEL}")
    one.encode_special_tokens = True
    other = sentencepiece.SentencePieceProcessor(model_file=f"{align.FOLDER}/{align.PIECES}")
    return lambda t: one.encode(" " + t, add_special_tokens=False).ids, lambda t: other.encode(t)


def ends(ids, spelt):
    return np.cumsum([len(spelt[i]) for i in ids]).tolist()


def plain(texts, both, libraries):
    """Per text the seven columns, by scanning all cuts and all pairs of tokens."""
    out, linked = [], []
    for text in texts:
        a, b = (f(text) for f in libraries) if text else ([], [])
        want = (" " + (text or "")).encode()
        if any(b"".join(t.spelt[i] for i in ids) != want for t, ids in zip(both, (a, b), strict=True)):
            a, b = [], []
        a_ends, b_ends = (ends(ids, t.spelt) for t, ids in zip(both, (a, b), strict=True))
        cuts = sorted(set(a_ends) & set(b_ends))
        groups, i, j = [], 0, 0
        for cut in cuts:
            i_end, j_end = a_ends.index(cut) + 1, b_ends.index(cut) + 1
            groups.append(",".join(map(str, a[i:i_end])) + "|" + ",".join(map(str, b[j:j_end])))
            i, j = i_end, j_end
        pairs = Counter()
        for x, (lo, hi) in zip(a, zip([0, *a_ends], a_ends, strict=False), strict=True):
            for y, (start, end) in zip(b, zip([0, *b_ends], b_ends, strict=False), strict=True):
                if lo < end and start < hi:
                    pairs[x, y] += 1
        digest = sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append([len(a), len(b), len(groups), pairs.total(), digest])
        linked.append(pairs)
    held, highest = Counter(k for pairs in linked for k in pairs), defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    for row, pairs in zip(out, linked, strict=True):
        row += [sum(n for k, n in pairs.items() if held[k] == highest[k[0]]), sum(n * held[k] for k, n in pairs.items())]
    return [tuple(r) for r in out]


TEXTS = [
    "Hello world, it's 12345 tokens!  Two  spaces\n\n\tand tabs ",
    " leading",
    "naïve café ½ ﬁ 日本語のテキスト Привет \U0001f600\U0001f469‍\U0001f469",
    "e\u0301 a\u0300",
    "<|endoftext|> <s> </s> <unk> <0x41> ▁ stays text",
    "▁",
    " ",
    "\n",
    "a",
    "\x00\x01 control",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9,
    "supercalifragilisticexpialidocious antidisestablishmentarianism",
]


def test_ids_are_those_of_the_libraries(both, libraries):
    rng = random.Random(1)
    letters = "aeé \n\t'sS1٣ß日\U0001f600.,#</"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randrange(1, 80))) for _ in range(400)]
    for t in texts:
        assert both[0].encode([" " + t])[0] == libraries[0](t)
        assert both[1].encode([t])[0] == libraries[1](t)


def test_division_finds_every_shared_cut():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a_ends, b_ends, starts, base = [], [], [], 0
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(1, 200))
            starts.append(len(a_ends))
            a_ends += (np.r_[rng.choice(n - 1, rng.integers(0, n), replace=False) + 1, n] if n > 1 else np.array([1])).tolist()
            inner = rng.choice(n - 1, rng.integers(0, n), replace=False) + 1 if n > 1 else []
            b_ends += np.r_[inner, n].tolist()
            a_ends[starts[-1] :] = sorted(a_ends[starts[-1] :])
            b_ends[len(b_ends) - len(inner) - 1 :] = sorted(b_ends[len(b_ends) - len(inner) - 1 :])
            a_ends[starts[-1] :] = [base + int(x) for x in a_ends[starts[-1] :]]
            b_ends[len(b_ends) - len(inner) - 1 :] = [base + int(x) for x in b_ends[len(b_ends) - len(inner) - 1 :]]
            base += n
        a, b = np.array(a_ends, np.int64), np.array(b_ends, np.int64)
        assert a[align.divide(a, b, np.array(starts))].tolist() == sorted(set(a_ends) & set(b_ends))


def test_division_without_texts():
    none = np.zeros(0, np.int64)
    assert align.divide(none, none, none).tolist() == []


def report(docs):
    return Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in align.link_report(docs).collect())


def test_report_matches_brute_force(corpus, both, libraries, monkeypatch):
    rng = random.Random(3)
    words = ["Hello", "tokenizer", "an", "de", "über", "naïve", "12", "x1y", "日本", "\n", "..", "antidis"]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(80)] + [None, "", "a", "a"]
    rows = [(i % 90, t) for i, t in enumerate(texts)]
    want = Counter((i, *r) for (i, _), r in zip(rows, plain(texts, both, libraries), strict=True))
    docs = corpus(rows)
    assert report(docs) == want
    assert report(docs.repartition(7)) == want  # other chunks
    monkeypatch.setattr(align, "SLICE_BYTES", 50)
    assert report(docs) == want


def test_odd_documents(corpus, odd, empty, both, libraries):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    some = [(i, t) for i, t in texts if len(t or "") < 1000]
    got = report(odd)
    assert got.total() == len(texts)
    alone = Counter((i, *r[:5]) for (i, _), r in zip(some, plain([t for _, t in some], both, libraries), strict=True))
    assert not alone - Counter(k[:6] for k in got.elements())
    long_ones = [k for k in got if k[1] > 10_000]
    assert len(long_ones) == 2 and all(k[3] <= min(k[1], k[2]) <= max(k[1], k[2]) <= k[4] < k[1] + k[2] for k in long_ones)
    assert report(empty) == Counter()
    none = corpus([(1, None), (None, "")])
    assert report(none) == Counter([(1, 0, 0, 0, 0, "", 0, 0), (None, 0, 0, 0, 0, "", 0, 0)])


def test_other_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([("k", "some text", 1, 2)], "key string, body string, chunk int, pairs int")
    row = align.link_report(docs, id_col="key", text_col="body").first()
    assert row.doc_id == "k" and row.n_groups > 0


def test_groups_spell_the_text(corpus, both):
    row = align.align_documents(corpus([(1, TEXTS[0])])).first()
    i = j = 0
    spelt = []
    for i_end, j_end in zip(row.a_cuts, row.b_cuts, strict=True):
        a = b"".join(both[0].spelt[k] for k in row.a_ids[i:i_end])
        assert a == b"".join(both[1].spelt[k] for k in row.b_ids[j:j_end])
        spelt.append(a)
        i, j = i_end, j_end
    assert b"".join(spelt) == b" " + TEXTS[0].encode()


def test_a_vocabulary_out_of_order_is_refused(tmp_path):
    path = tmp_path / "v.json"
    path.write_text('{"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}')
    with pytest.raises(ValueError, match="merges"):
        align.byte_level(str(path))
