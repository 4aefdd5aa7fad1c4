"""Operators over whole tables, against brute force, and the pipeline."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from parcelwatch.llm import common, decontaminate, mixing, queries, simhash, warc

# --- graph and fingerprints -----------------------------------------------------------------


def closure(n, linked):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(i) for i in range(n)]


def test_components_match_a_closure(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    edges = spark.createDataFrame([*pairs, (5, None)], "u long, v long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    want = closure(461, pairs)
    assert all(got.get(i, i) == want[i] for i in range(461))
    assert common.components(edges.filter("false")).count() == 0


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    found = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def test_fingerprints_match_their_definition():
    texts = [None, "", " ", "One", "One two", "A b\tC d  e", "É x y z é", "a b c " * 40]
    got = simhash.fingerprints(texts)
    assert [int.from_bytes(g.tobytes(), "big") for g in got] == [plain_fingerprint(t) for t in texts]


def test_comparison_finds_all_near_pairs():
    rng = np.random.default_rng(3)
    for bits, radius in ((64, 3), (64, 0), (128, 9)):
        centres = rng.integers(0, 2, (12, bits), dtype=np.uint8)
        rows = centres[rng.integers(0, 12, 400)]
        flips = rng.random(rows.shape) < radius / bits
        prints = np.packbits(rows ^ flips, axis=1)
        group = np.sort(rng.integers(0, 4, 400))
        got = {(r, s + k) for r, s, b in simhash.near(prints, group, radius) for k in range(64) if b >> k & 1}
        wide = np.unpackbits(prints, axis=1).astype(int)
        far = (wide[:, None] != wide[None]).sum(axis=2)
        want = {(i, j) for i, j in zip(*np.nonzero(far <= radius), strict=True) if group[i] == group[j]}
        assert got == want


def test_exact_keys_meet_within_the_radius():
    masks = simhash.key_masks(simhash.CLOSE)
    rng = np.random.default_rng(1)
    for _ in range(500):
        changed = np.isin(np.arange(64), rng.choice(64, 3, replace=False))
        assert any(not (m & changed).any() for m in masks)


def test_groups_match_brute_force(corpus, odd, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)  # so that large keys are cut
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(300)]
        for k in range(rng.randint(1, 5)):
            if k:
                words[rng.randrange(300)] = rng.choice(vocabulary)
            rows.append((1000 + len(rows) * 7 % 999, " ".join(words)))
    docs = corpus(rows).unionByName(odd)
    got = simhash.group(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain_fingerprint(t) for _, t in texts]
    n = len(texts)
    near = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    tops = closure(n, near)
    smallest = {}
    for (i, _), t in zip(texts, tops, strict=True):
        if i is not None:
            smallest[t] = min(smallest.get(t, i), i)
    want = Counter((i, f"{p:016x}", smallest.get(t)) for (i, _), p, t in zip(texts, prints, tops, strict=True))
    assert Counter((r.doc_id, r.fp.hex(), r.component_id) for r in got) == want


def test_one_document_of_each_group_stays(corpus, odd, empty):
    """The smallest id of each group of fingerprints, by brute force, whatever the number of copies."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for f in range(40):
        words = [rng.choice(vocabulary) for _ in range(400)]
        for k in range(4):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(400)] = rng.choice(vocabulary)
            rows += [(len(rows) + i, " ".join(copy), "en", "s", 1) for i in range(30 if (f, k) == (3, 1) else 1)]
    prints = [plain_fingerprint(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    tops = closure(len(rows), near)
    kept = simhash.deduplicate(corpus(rows))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(tops))
    assert 40 <= len(set(tops)) < 120
    once = simhash.deduplicate(odd).collect()
    assert len({r.text for r in once} - {None, "", " \n\t "}) == len([r for r in once if (r.text or "").strip()])
    assert sum(r.text == "same text here" for r in once) == 1
    assert simhash.deduplicate(empty).count() == 0


def test_links_of_near_copies_stay_few(spark):
    """A star a key at most: n near-copies have fewer than n links for each of the ten keys."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, 64, dtype=np.uint8)
    prints = {bytes(np.packbits(base ^ (np.isin(np.arange(64), rng.choice(64, 2, replace=False))))) for _ in range(3000)}
    classes = spark.createDataFrame([(bytearray(p),) for p in prints], "fp binary")
    found = simhash.link(classes, simhash.CLOSE)
    assert found.count() < 10 * len(prints)
    assert common.components(found).select("root").distinct().count() == 1


# --- archives -------------------------------------------------------------------------------


def test_records_survive_a_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a.org/x", "<p>Hé\r\n\r\nWARC/1.1\r\n &lt;b&gt;</p>"), (2, None, None), (None, "u", ""), (1, "http://a.org/x", "<p>again")],
        "page_id long, url string, html string",
    )
    sources = warc.responses(pages)
    made = warc.derive(sources)
    assert made.count() == 8
    records = sources.unionByName(made)
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write(records, path, compression)
        back = warc.read(spark, path)
        names = back.columns
        plain = lambda df: Counter((*(r[n] for n in names if n != "headers"), tuple(sorted(r.headers.items()))) for r in df.collect())
        assert plain(back) == plain(records.select(names))
    responses = {r.record_id: r for r in sources.collect()}
    for r in made.collect():
        source = responses[r.refers_to]
        assert r.headers["WARC-Source-Payload-Digest"] == source.headers["WARC-Payload-Digest"]
        assert r.target_uri == source.target_uri
        if r.type == "metadata":
            assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in r.block
    texts = {r.block for r in made.filter("type = 'conversion'").collect()}
    assert "Hé WARC/1.1 <b>" in texts and "" in texts
    assert warc.derive(warc.responses(pages.filter("false"))).count() == 0


def stripped(html):
    """The visible words of a well-formed page: what is between tags, but for hidden elements."""
    from html import unescape

    html = re.sub(r"<!--.*?-->|<!doctype[^>]*>", " ", html, flags=re.S | re.I)
    html = re.sub(r"<(script|style|noscript|template|head|iframe|svg)\b.*?</\1\s*>", " ", html, flags=re.S | re.I)
    inline = "a|b|i|em|strong|span|u|small|code|sup|sub|mark|time|abbr|cite|q|s|label|button|textarea|input|select|img"
    html = re.sub(rf"</?(?:{inline})\b[^>]*>", "", html, flags=re.I)
    return unescape(re.sub(r"<[^>]*>", " ", html)).split()


def test_visible_text_equals_stripped_tags(spark):
    """An independent reading of the given pages, which are well formed."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    assert len(pages) > 20
    for r in pages:
        assert " ".join(warc.plain_lines(r.html)).split() == stripped(r.html)
    assert warc.plain_lines("a<!-- never closed <p>b") == ["a"]


def test_records_of_long_odd_and_text_ids(spark):
    rows = [("7", "u", "<p>" + "long " * 50_000), ("x-1", "u", "\r\n\x00<p>a\u2028b</p>"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    made = warc.derive(warc.responses(pages)).collect()
    assert sorted((r.page_id is None, r.type) for r in made) == [(False, "conversion"), (False, "metadata")] + [(True, "conversion")] * 2 + [(True, "metadata")] * 2
    assert len({r.record_id for r in made}) == 6
    texts = {len(r.block) for r in made if r.type == "conversion"}
    assert 50_000 * 5 - 1 in texts
    assert warc.derive(warc.responses(pages.filter("false"))).count() == 0


def test_odd_elements_do_not_take_the_rest_of_the_page():
    cases = {
        '<p>one</p><svg class="i"/><p>two</p><p>three</p>': ["one", "two", "three"],
        "<title-bar><p>a</p></title-bar><object-card>b</object-card><p>c": ["a", "b", "c"],
        '<p>x <a title="see <script> tag">y</a> z</p><p>w': ["x y z", "w"],
        "<p>a</p><object data=x><p>b</p><p>c": ["a", "b", "c"],
        "<p>a<iframe src=x><p>b</p>": ["a", "b"],
        "<title/><p>a</p><p>b": ["a", "b"],
        "<html><head><title>t</title><body><p>a</p></body></html>": ["a"],
        "<p>a<svg><text>t</text></svg>b<span hidden>c</span></p><div style='display:none'><p>d</p></div>": ["ab"],
        "<object><p>a</p></object><svg><title>t</title></svg><p>b": ["b"],
    }
    for html, want in cases.items():
        assert warc.plain_lines(html) == want, html
    metadata, text = warc.derived("HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>go <a href=x>there</a></p>")
    assert text == "go there" and metadata.endswith("link-chars: 5\r\n")


# --- decontamination ------------------------------------------------------------------------


def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_matches_the_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(150):
        item = rng.integers(1, 6, rng.integers(1, 12))
        width = rng.integers(1, 20)
        parts = np.full((3, width), -1)
        for r in range(3):
            n = rng.integers(0, width + 1)
            parts[r, :n] = rng.integers(1, 6, n)
        score, start, end = decontaminate.align(item, parts)
        for r in range(3):
            there = parts[r][parts[r] >= 0].tolist()
            assert score[r] == plain_alignment(item.tolist(), there)
            if score[r]:
                assert plain_alignment(item.tolist(), there[start[r] : end[r]]) == score[r]


def test_copies_are_found_and_clean_documents_left(corpus, odd, empty, spark):
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(400)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [prose(rng.randint(15, 60)) for _ in range(30)]
    rows, planted = [], set()
    for i in range(300):
        words = prose(rng.randint(0, 400))
        if i % 3 == 0:  # a third of the documents hold the same item
            k = 0 if i % 6 else rng.randrange(30)
            copy = [w if rng.random() > 0.1 else rng.choice(vocabulary) for w in items[k]] if i % 2 else list(items[k])
            at = rng.randint(0, len(words))
            words[at:at] = copy
            planted.add((i, k))
        rows.append((i, ", ".join(words).upper() if i % 4 == 0 else " ".join(words)))
    bench = spark.createDataFrame(
        [(k, " ".join(w) + ".") for k, w in enumerate(items)] + [(90, None), (91, "too short"), (None, "")],
        "item_id long, text string",
    )
    docs = corpus(rows)
    found = decontaminate.find(docs.unionByName(odd), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted
    texts = dict(rows)
    for r in found:
        part = decontaminate.tokens(texts[r.doc_id][r.start : r.end])
        assert plain_alignment(items[r.item_id], part) == r.matched
    kept = decontaminate.remove(docs.unionByName(odd), bench)
    assert kept.columns == docs.columns
    assert kept.count() == 300 - len({i for i, _ in planted}) + odd.count()
    assert decontaminate.find(docs, bench.filter("false")).count() == 0
    assert decontaminate.remove(empty, bench).count() == 0


def test_seeds_change_the_rows_joined_but_no_result(corpus, spark, monkeypatch):
    rng = random.Random(13)
    common = [f"c{i}" for i in range(6)]  # phrases that documents and items share
    items = [[rng.choice(common if rng.random() < 0.5 else [f"i{k}w{n}" for n in range(20)]) for _ in range(30)] for k in range(25)]
    rows = []
    for i in range(200):
        words = rng.choices(common, k=60)
        if i % 4 == 0:
            words[20:20] = [w if rng.random() > 0.15 else "x" for w in items[i // 8]]
        rows.append((i, " ".join(words)))
    docs = corpus(rows)
    bench = spark.createDataFrame([(f"item {k}", " ".join(w)) for k, w in enumerate(items)], "item_id string, text string")
    joined, found = {}, {}
    for share, rows_sent in ((0.05, 1 << 22), (0.5, 1 << 22), (1.0, 1 << 22), (0.5, 0)):
        monkeypatch.setattr(decontaminate, "SEED_SHARE", share)
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows_sent)
        known = decontaminate.items_of(bench, "item_id", "text")
        grams = known.select(F.explode("grams").alias("gram")).distinct()
        key = docs.select(F.xxhash64("doc_id").alias("row_key"), F.hash("doc_id").alias("row_check"), F.explode(decontaminate.document_grams(F.col("text"))).alias("gram"))
        met = key.join(grams, "gram")
        seeds = decontaminate.seeds_of(known, met)
        joined[share, rows_sent] = (seeds.count(), met.join(seeds, "gram").count())
        found[share, rows_sent] = sorted((r.doc_id, r.item_id, r.matched, r.start, r.end) for r in decontaminate.find(docs, bench).collect())
    assert len({str(f) for f in found.values()}) == 1
    assert joined[0.05, 1 << 22][1] < joined[0.5, 1 << 22][1] < joined[1.0, 1 << 22][1]
    plain = {(i, k) for i, t in rows for k, w in enumerate(items) if 2 * plain_alignment(w, t.split()) >= len(w)}
    assert {(r[0], int(r[1].split()[1])) for r in found[0.5, 0]} == plain and len(plain) >= 25


def test_documents_meet_items_in_a_join_on_seeds(corpus, spark):
    docs = corpus([(1, "one two three four five six")])
    bench = spark.createDataFrame([(1, "two three four five")], "item_id long, text string")
    known = decontaminate.items_of(bench, "item_id", "text")
    met = docs.select(F.lit(1).alias("row_key"), F.lit(2).alias("row_check"), F.explode(decontaminate.document_grams(F.col("text"))).alias("gram"))
    found = decontaminate.candidates_of(met, decontaminate.seeds_of(known, met))
    assert re.search(r"Join \[gram", found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 1


def test_edited_copies_are_found_as_plain_alignment_finds_them(corpus, spark):
    rng = random.Random(12)
    item_words, other = [f"w{i}" for i in range(300)], [f"x{i}" for i in range(300)]
    items = [[rng.choice(item_words) for _ in range(rng.randint(15, 59))] for _ in range(40)]
    rows, want = [], set()
    for how in ("change 3", "change 4", "change 5", "change 6", "change 7", "add 2", "add 3", "drop 4"):
        kind, k = how.split()
        for n, item in enumerate(items):
            copy = []
            for i, w in enumerate(item, 1):
                copy += [w] if i % int(k) else {"change": [rng.choice(other)], "add": [w, rng.choice(other)], "drop": []}[kind]
            words = [rng.choice(other) for _ in range(60)]
            words[30:30] = copy
            for exact in (False, True):  # alone, and with an exact copy in the corpus
                if exact and n % 2 == 0:
                    continue
                rows.append((len(rows), " ".join(item if exact else words)))
                if exact or 2 * plain_alignment(item, words) >= len(item):
                    want.add((rows[-1][0], n))
    assert len(want) > 6 * len(items)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find(corpus(rows), bench).collect()}
    assert found == want


def test_exact_copies_of_short_items_are_found(corpus, spark):
    items = [[f"i{n}w{k}" for k in range(n)] for n in range(3, 13)]
    rows = [(i, " ".join(["x", "y", *item, "z"])) for i, item in enumerate(items)]
    for item in items[4:]:  # uneven frequencies: the n-gram in the middle is the rarest of all runs
        for k in range(len(item) - 2):
            if k != (len(item) - 3) // 2:
                rows.append((len(rows), " ".join(item[k : k + 3])))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find(corpus(rows), bench).collect()}
    assert found == {(i, i) for i in range(len(items))}


# --- mixing ---------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([]) == []
    assert mixing.targets([0, 0]) == [0, 0]
    got = mixing.targets([100, 100, 100])
    assert got == [200, 250 / 3, 500 / 3]
    assert sum(mixing.targets([5, 50, 500, 7])) == 1.5 * 562
    assert all(t <= 2 * s for t, s in zip(mixing.targets([5, 50, 500, 7]), [5, 50, 500, 7], strict=True))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        index = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(0).cast("long"))
        got = [r[0] for r in spark.range(n).select(index).collect()]
        assert sorted(got) == list(range(n))
        assert n < 1000 or sum(a == b for a, b in enumerate(got)) < 20


def test_draws_meet_the_quotas():
    drawn = mixing.draw_shards([1000, 0, 300, 77], 13)
    assert drawn.sum(axis=0).tolist() == [1000, 0, 300, 77]
    assert drawn.sum(axis=1).max() - drawn.sum(axis=1).min() <= 1
    assert len(set(drawn[:, 0].tolist())) > 3


def test_every_shard_is_drawn():
    """Shares of the shards spread as a multinomial's do, also after the quotas are met."""
    quotas = [6000, 3000, 900, 100]
    seen = np.concatenate([mixing.draw_shards(quotas, 10, seed=s) for s in range(200)])
    assert (seen >= 0).all() and set(seen.sum(axis=1).tolist()) == {1000}
    share = np.array(quotas) / 10_000
    assert np.allclose(seen.mean(axis=0), 1000 * share, rtol=1e-9)
    spread = seen.std(axis=0) / np.sqrt(1000 * share * (1 - share))
    assert (0.8 < spread).all() and (spread < 1.1).all()
    assert mixing.draw_shards([5, 3], 1).tolist() == [[5, 3]]
    assert mixing.draw_shards([0, 0], 2).tolist() == [[0, 0], [0, 0]]


def test_slots_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TASK_SLOTS", 1000)
    monkeypatch.setattr(mixing, "_STEP", 100)
    sources = [mixing.Source(0, "a", 10, 128 * 20_000, 128 * 20_000.0), mixing.Source(1, "b", 10, 128 * 100, 128 * 150.0)]
    slots = mixing.slots_of(spark, sources)
    sizes = [r[1] for r in slots.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_150 and len(sizes) >= 15 and max(sizes) < 4000
    assert slots.select("number", "slot").distinct().count() == 20_150


def test_mix_takes_what_it_says(corpus, odd, empty):
    rng = random.Random(11)
    rows = [(i % 190, " ".join(f"d{i}w{k}" for k in range(rng.randint(0, 700))), "en", rng.choice("abbbbb")) for i in range(200)]
    docs = corpus([*rows, rows[0], rows[0]]).unionByName(odd)
    account = mixing.account(docs).collect()
    assert len(account) == docs.count()
    sums = Counter()
    for r in account:
        assert 0 <= r.taken <= 2 * r.size
        sums[r.source_size, r.target] += r.taken
    assert all(abs(t - target) <= 1 for (_, target), t in sums.items())
    blocks = mixing.mix(docs).collect()
    assert sum(b.n_words for b in blocks) == sum(r.taken for r in account)
    assert all(len(b.text.split()) == b.n_words <= mixing.BLOCK for b in blocks)
    uses = Counter(w for b in blocks for w in b.text.split() if w.startswith("d"))
    assert max(uses[w] / n for w, n in Counter(w for r in [*rows, rows[0], rows[0]] for w in r[1].split()).items()) <= 2
    again = mixing.account(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, account))
    assert mixing.account(empty).count() == 0 and mixing.mix(empty).count() == 0


# --- pipeline and registration --------------------------------------------------------------


def test_stages_keep_their_promises(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf), name)
        if name == "mixing":
            assert {"shard", "source", "text", "n_words"} <= set(docs.columns)
            assert docs.agg(F.sum("n_words")).first()[0] == sum(
                r.taken for r in mixing.account(before).collect()
            )
        else:
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
            assert docs.count() > 0.7 * before.count()


def folders(spark):
    from parcelwatch.session import shared_dir
    from parcelwatch.sources import storage

    return {n for n in storage.names(spark, shared_dir(spark)) if n.startswith("llm-")}


def test_what_a_job_writes_on_the_way_goes(spark):
    before = folders(spark)

    def make():
        inner = common.settled(spark, lambda: common.written(spark.range(5), "deep").filter("id > 0"), "inner")
        return common.written(inner, "middle").filter("id > 1")

    assert sorted(r.id for r in common.settled(spark, make, "whole").collect()) == [2, 3, 4]
    (left,) = folders(spark) - before
    assert left.startswith("llm-whole-")

    def fail():
        common.written(spark.range(3), "lost")
        raise ValueError("no result")

    with pytest.raises(ValueError, match="no result"):
        common.settled(spark, fail, "never")
    assert folders(spark) - before == {left} and common._open == []


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Null ids, texts of all kinds and columns named like the code's own pass all stages."""
    names = ("fp", "row", "row_key", "pii", "score", "number", "language", "component_id", "text_hash")
    clashing = odd.select("*", *(F.lit(f"x{i}").alias(n) for i, n in enumerate(names)))
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "")], "item_id long, text string")
    for name, docs in (("odd", clashing), ("empty", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        before = folders(spark)
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {"shard", "source", "text", "n_words"} <= set(got.columns)
        stages = [n.removeprefix("llm-").rpartition("-")[0] for n in folders(spark) - before]
        assert {n for n, _ in corpus_pipeline.STAGES[:-1]} <= set(stages)
        if name == "empty":
            assert got.count() == 0
        else:
            got.write.format("noop").mode("overwrite").save()


def test_no_machine_local_state():
    """What the corpus operators may not use, as executors can be lost at any time."""
    import ast
    from pathlib import Path

    banned = {"localCheckpoint", "crossJoin", "rdd", "cache", "persist", "mkdtemp"}
    files = [*Path(common.__file__).parent.glob("*.py"), Path(corpus_pipeline.__file__)]
    for path in files:
        for node in ast.walk(ast.parse(path.read_text())):
            assert not (isinstance(node, ast.Attribute) and node.attr in banned), path


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    found = {re.match(r"op(\d+)_", q)[1] for q in queries.QUERIES}
    assert found == {str(n) for n in range(1, 14)}
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())


def test_quality_rules_match_their_sql(spark):
    from checks.compare import connect, rows_of

    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op5_quality_rules"](spark, sf)
    result = connect(sf).execute(queries.SQL["op5_quality_rules"])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, result.fetchall())
