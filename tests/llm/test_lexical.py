"""Reversed lexical search against a plain ranking of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from parcelwatch.llm import lexical, queries

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, best):
    held = [plain_terms(t) for _, t in docs]
    n_docs, n_terms = sum(map(bool, held)), sum(map(len, held))
    df = Counter(t for ts in held for t in set(ts))
    out = Counter()
    for item_id, text in items:
        scores = []
        for (doc_id, _), ts in zip(docs, held, strict=True):
            tf, total = Counter(ts), 0
            for t in plain_terms(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + 25 * len(ts) * n_docs // n_terms
                    total += w * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
            if total > 0:
                scores.append((-total, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scores)[:best], 1):
            out[item_id, rank, doc_id, -score] += 1
    return out


def found(docs, items, best=lexical.BEST):
    return Counter(tuple(r) for r in lexical.search(docs, items, best).select("item_id", "rank", "doc_id", "score").collect())


def test_terms_match_the_pattern():
    rng = random.Random(1)
    letters = [chr(c) for c in range(256)] + ["é", "İ", "ſ", "K", "\u2028", "\u3000", "\U0001f600", "日"]
    for _ in range(500):
        text = "".join(rng.choices(letters, k=40))
        assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)
    assert lexical.terms(None) == []


def test_heaps_keep_the_best_and_lowest_ids():
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 5, (200, 3))
    ids = [None if i % 50 == 7 else int(x) for i, x in enumerate(rng.permutation(200))]
    heaps = lexical.Heaps(3, 10)
    for at in range(0, 200, 17):
        heaps.add(scores[at : at + 17], ids[at : at + 17])
    got = sorted((i, -s, d is None, d or 0) for i, d, s in heaps.rows())
    want = []
    for i in range(3):
        want += sorted((i, -int(scores[d, i]), ids[d] is None, ids[d] or 0) for d in range(200) if scores[d, i])[:10]
    assert got == sorted(want)


def test_search_matches_plain_ranking(corpus, odd, spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "Foo-bar", "x_y", "naïve", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(300)]
    rows += [(i % 40 + 500, "w1 w2 copy copy") for i in range(90)] + [(None, "w1 w2 copy copy"), (7, None)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "nowhere to be found"), (None, "copy w1 w1"), (3, "copy"), (3, "copy"), (33, "same TEXT here")]
    docs = corpus(rows).unionByName(odd)
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    for best in (20, 3):
        want = plain_search(pairs, items, best)
        assert found(docs.repartition(5), bench, best) == want
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 40)
    monkeypatch.setattr(lexical, "CELLS", 64)
    monkeypatch.setattr(lexical, "MERGED_TASKS", 2)
    assert found(docs.repartition(11), bench, 3) == want


def test_empty_tables_and_clashing_columns(corpus, empty, spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = corpus([(1, "a")])
    assert found(empty, bench) == Counter()
    assert found(docs, bench.filter("false")) == Counter()
    odd = spark.createDataFrame([("d", "a b", 1, 2, 3)], "k string, body string, item int, score int, rank int")
    named = spark.createDataFrame([("i", "b", 1)], "name string, q string, task int")
    got = lexical.search(odd, named, id_col="k", text_col="body", item_id_col="name", item_text_col="q").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [("i", 1, "d")]


def test_query_equals_its_sql(spark):
    from checks.compare import connect, rows_of

    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op13_lexical_search"](spark, sf)
    result = connect(sf).execute(queries.SQL["op13_lexical_search"])
    names = [d[0] for d in result.description]
    rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert sorted(names) == sorted(got.columns) and rows == rows_of(names, result.fetchall())
    assert len(rows) > 20
