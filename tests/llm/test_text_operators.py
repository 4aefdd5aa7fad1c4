"""Operators on single texts, against plain rewritings of their definitions."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwatch.llm import html_text, langid, pii, quality_model, quality_rules, toxicity

# --- quality rules --------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_match_their_definitions(corpus, odd):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab #\n\té") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    docs = corpus([(100 + i, t) for i, t in enumerate(texts)]).unionByName(odd)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality_rules.judge(docs).select("text", *(f"measures.{n}" for n in names), "base_failed").collect()
    assert len(got) == len(texts) + 11
    for row in got:
        want = plain_measures(row.text)
        assert tuple(row)[1:6] == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_rules_name_what_is_broken_and_keep_prose(corpus):
    prose = " ".join(f"the word{i} of text{i}" for i in range(40))
    shout = prose.upper()
    rows = {r.doc_id: r for r in quality_rules.judge(corpus([(1, prose), (2, shout), (3, "# $ " * 60)])).collect()}
    assert rows[1].kept and rows[1].broken == []
    assert "capitals" in rows[2].broken and not rows[2].kept
    assert not rows[3].kept


def test_rules_run_without_python(odd):
    plan = quality_rules.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- main text ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("a &amp; b&nbsp; c", "a & b c"),
        ("<nav>menu</nav><article><h1>T</h1><p>one<br>two<p>three</article><footer>f</footer>", "T one two three"),
        ("<article><p>in<b>li</b>ne</p><script>var x='</p>'</script><style>p{}</style></article>", "inline"),
        ("<article><p>text</p><section class='comments'><p>reader</p></section></article>", "text"),
        ("<main><header><h1>Title</h1></header><p>body</p><aside>side</aside></main>", "Title body"),
        ("<div class='ad'>buy</div><div hidden>no</div><form><p>mail</p></form><p>rest", "rest"),
        ("<table><tr><td>a<td>b</table>", "a b"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def test_clusters_part_content_from_links():
    long = "A sentence with quite some words in it, as articles have them. " * 3
    links = "".join(f"<div><a href={i}>link {i}</a></div>" for i in range(6))
    page = f"<body>{links}<h2>Heading</h2><p>{long}</p><p>Short one.</p><p>{long}</p>{links}</body>"
    want = " ".join(f"Heading {long} Short one. {long}".split())
    assert html_text.main_text(page) == want


def test_names_of_themes_do_not_put_the_article_aside():
    for names in ("content no-sidebar", "site-main has-sidebar", "post type-post category-legal", "hentry tag-social-media"):
        for tag in ("div", "article", "main", "section"):
            page = f"<div class='wrap has-sidebar'><{tag} class='{names}'><p>The whole text.</p></{tag}></div>"
            assert html_text.main_text(page) == "The whole text.", (names, tag)
    assert html_text.main_text("<article id='comment' class='search'><p>text</p></article>") == "text"
    for names in ("sidebar", "related-posts", "site-footer", "ad", "ad-300x250", "cookie-banner", "comments-area", "main-nav", "x share"):
        assert html_text.main_text(f"<div class='{names}'>aside</div><p>text") == "text", names


def test_ratios_check_what_pages_call_their_article():
    long = "A sentence with quite some words in it, as articles have them. " * 3
    main = "".join(f"<div>{k} {long}</div>" for k in range(4))
    want = " ".join(" ".join(f"{k} {long}" for k in range(4)).split())
    links = "".join(f"<div><a href={i}>link {i}</a></div>" for i in range(8))
    for teaser in ("<article><p>Read on</p></article>", "<div class=entry><a href=x>More</a></div>", "<div class=post>Old</div>"):
        assert html_text.main_text(f"<body>{teaser}{links}{main}{links}</body>") == want, teaser
    article = "<article><h1>Title</h1><ul><li>a<li>b</ul>" + main + "</article>"
    assert html_text.main_text(f"<body>{links}{article}<div>{long}</div></body>") == f"Title a b {want}"


def test_what_stands_aside_inside_a_paragraph_goes():
    inner = "<span class='advert'>BUY</span> <button>SHARE</button><a class='share'>TWEET</a><span class='breadcrumb'>HOME</span><textarea>TA</textarea><label>L</label>"
    page = f"<article><p>The article says one thing.</p><p>And {inner} another.</p><p>{inner}</p></article>"
    assert html_text.main_text(page) == "The article says one thing. And another."
    assert "BUY" in html_text.visible_text(page)


def test_an_unclosed_menu_does_not_hide_the_article():
    page = "<div><nav><a>menu</a><article><p>The text of the article, long enough.</p>{}</article>{}"
    assert html_text.main_text(page.format("<aside><p>side</p></aside>", "")) == "The text of the article, long enough."
    closed = page.format("", "</nav></div><p>And text outside of the menu.</p>")
    assert html_text.main_text(closed) == "And text outside of the menu."
    assert html_text.main_text("<p>text</p><footer><p>cut off here") == "text"


def test_clusters_take_or_leave_the_article_as_a_whole():
    """Short lines stand with their article; without names only ratios speak."""
    lines = html_text.lines_of("<article><h1>T</h1><p>" + "word " * 60 + "</p><p>x</p></article><div><i>a</i><b>b</b></div>")
    assert html_text.by_ratios(lines) == [True, True, True, False]
    plain = html_text.lines_of("<div>" + "word " * 60 + "</div><div>" + "<i>a</i>" * 9 + "</div><div><i>a</i><b>b</b></div>" * 3)
    assert html_text.by_ratios(plain)[0] and not any(html_text.by_ratios(plain)[2:])


@pytest.mark.parametrize(
    "page",
    [
        "<a>" * 30_000 + "</i>" * 30_000,
        "<i><table>" + "<a>" * 30_000 + "</i>" * 30_000,
        "<div>" + "<a>" * 30_000 + "<hr>" * 30_000,
        "<svg>x" * 30_000,
        "<nav><article>x" * 20_000,
        "<div>" * 100_000 + "x" + "</div>" * 100_000,
        "<![CDATA[" * 30_000,
        "<a href='" * 30_000,
        "<!--" * 60_000,
        "<" * 200_000,
    ],
    ids=lambda p: p[:12],
)
def test_time_is_linear_in_the_page(page):
    import time

    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 8  # seconds; quadratic ones took minutes


def test_long_pages_and_empty_tables(spark):
    long = "<article>" + "".join(f"<p>paragraph {i} of the text</p>" for i in range(30_000)) + "</article>"
    pages = spark.createDataFrame([(1, long)], "page_id long, html string")
    assert len(html_text.extract_pages(pages).first().text) == sum(len(f"paragraph {i} of the text ") for i in range(30_000)) - 1
    assert html_text.extract_pages(pages.filter("false")).count() == 0


def test_smoothing_is_a_weighted_mean():
    assert np.allclose(html_text.smooth(np.ones(5)), 1)
    assert html_text.smooth(np.array([0.0, 0, 9, 0, 0])).argmax() == 2


def test_extracts_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 7), (None, None, None, None)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert got == {1: "a", None: ""}


# --- language -------------------------------------------------------------------------------


def test_languages_held_out(corpus, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.filter(~held))
    got = langid.identify(docs.filter(held), model).select("lang", "language.*").toDF("lang", "said", "score").collect()
    assert sum(r.lang == r.said for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean(model.weights == 0) > 0.3


def test_languages_of_odd_texts(odd, empty):
    model = langid.train(odd)
    rows = langid.identify(odd, model).collect()
    for r in rows:
        assert r.language.lang == ("und" if not re.search(r"[^\W\d_]", r.text or "") else "en")
    assert langid.keep_identified(odd, model).columns == odd.columns
    nothing = langid.train(empty)
    assert {r.language.lang for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_gram_counts_do_not_depend_on_pieces(monkeypatch):
    text = "".join(chr(97 + i * i % 26) for i in range(500))
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "_PIECE", 64)
    cut = langid.gram_counts(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_temperature_lowers_overconfidence():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    logits = np.eye(2)[np.where(rng.random(400) < 0.7, y, 1 - y)] * 20
    assert langid.temperature(logits, y) > 5


# --- toxicity -------------------------------------------------------------------------------


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.new_network(np.zeros(4, np.float32), np.zeros(toxicity.CHAR_BUCKETS, np.float32))
    net = {k: v.astype(np.float64) for k, v in net.items()}
    x = rng.normal(size=(toxicity.WINDOW, toxicity.WORD_DIM + toxicity.CHAR_DIM, 5))
    mask = np.ones((toxicity.WINDOW, 5), bool)
    mask[7:, 0] = False
    y = np.array([1, 0, 1, 0, 1])

    def loss():
        states = [
            toxicity.recur(net, s, lambda t, s=s: net[f"w{s}"] @ x[t] + net[f"b{s}"][:, None], mask).astype(float)
            for s in "fb"
        ]
        z = toxicity.attend(net, np.concatenate(states, axis=1), mask)[0]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    grads, _ = toxicity.gradients(net, x, mask, y)
    for name in ("wf", "ub", "wa", "va", "wo", "bf"):
        at = tuple(d // 2 for d in net[name].shape)
        before, eps = net[name][at], 1e-3
        net[name][at] = before + eps
        up = loss()
        net[name][at] = before - eps
        down = loss()
        net[name][at] = before
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3, name


def test_windows_cover_every_word():
    for n in (0, 1, 11, 12, 13, 18, 100):
        wins = toxicity.windows(np.arange(1, n + 1))
        assert set(wins.ravel()) - {0} == set(range(1, n + 1))


def plain_window(net, x):
    """The logit of one window of input vectors, step by step."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, sides = toxicity.HIDDEN, []
    for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        w, u, bias = (net[f"{k}{side}"].astype(float) for k in "wub")
        state, states = np.zeros(h), {}
        for t in order:
            now, past = w @ x[t] + bias, u @ state
            reset, update = sig(now[:h] + past[:h]), sig(now[h : 2 * h] + past[h : 2 * h])
            new = np.tanh(now[2 * h :] + reset * past[2 * h :])
            state = new + update * (state - new)
            states[t] = state
        sides.append([states[t] for t in range(len(x))])
    both = [np.concatenate(pair) for pair in zip(*sides, strict=True)]
    e = np.array([net["va"] @ np.tanh(net["wa"] @ s + net["ba"]) for s in both])
    share = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return float(net["wo"] @ sum(a * s for a, s in zip(share, both, strict=True)) + net["bo"][0])


@pytest.fixture(scope="module")
def some_model():
    rng = random.Random(4)
    calm = [f"{a}{b}" for a in ("lo", "ma", "ti", "re", "sun") for b in ("ra", "nel", "dor", "ka", "vis", "pol")]
    texts = [[rng.choice(calm) for _ in range(rng.randint(15, 60))] for _ in range(200)]
    for i in range(0, 200, 4):
        texts[i][rng.randrange(len(texts[i]))] = rng.choice(("grobnak", "vilfurz"))
    model = toxicity.fit([" ".join(t) for t in texts], [int(i % 4 == 0) for i in range(200)], rounds=2, steps=40)
    return model, calm, rng


def test_a_score_is_the_worst_of_every_window_by_a_plain_recurrence(some_model, monkeypatch):
    model, calm, rng = some_model
    net, size = model.net, toxicity.WINDOW
    texts = [" ".join(rng.choices([*calm, "grobnak", "new", "x"], k=n)) for n in (1, 5, 11, 12, 13, 40, 90)] + [None, "", "?!"]
    for at_a_time in (2048, 7):
        monkeypatch.setattr(toxicity, "SLICE", at_a_time)
        got, first = toxicity.Scorer(model).score(texts)
        for text, s, k in zip(texts, got, first, strict=True):
            words = toxicity.tokens(text)
            if not words:
                assert (s, k) == (0, -1)
                continue
            buckets, sizes = toxicity.char_grams(words)
            cuts = np.split(net["char"][buckets], np.cumsum(sizes)[:-1])
            x = [np.r_[net["word"][model.vocabulary.get(w, 0)], c.mean(axis=0)] for w, c in zip(words, cuts, strict=True)]
            logits = [plain_window(net, x[i : i + size]) for i in range(max(1, len(x) - size + 1))]
            assert abs(logits[k] - max(logits)) < 1e-4
            margin = model.slope * (max(logits) - model.cut) + np.log(0.7 / 0.3)
            assert abs(s - 1 / (1 + np.exp(-margin))) < 1e-3


def test_words_around_a_passage_never_lower_its_score(some_model):
    model, calm, rng = some_model
    scorer = toxicity.Scorer(model)
    for _ in range(30):
        words = rng.choices([*calm, "grobnak"], k=rng.randint(12, 30))
        alone = scorer.score([" ".join(words)])[0][0]
        around = [" ".join([*rng.choices(calm, k=k), *words, *rng.choices(calm, k=k % 3)]) for k in range(7)]
        assert (scorer.score(around)[0] >= alone - 1e-6).all()


def test_toxicity_learns_words_and_stands_odd_texts(corpus, odd, empty, spark):
    rng = random.Random(4)
    calm = [f"{a}{b}" for a in ("lo", "ma", "ti", "re", "sun") for b in ("ra", "nel", "dor", "ka", "vis", "pol")]
    rows, marks = [], []
    for i in range(240):
        words = [rng.choice(calm) for _ in range(rng.randint(15, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(("grobnak", "vilfurz"))
        rows.append((1000 + i, " ".join(words)))
        marks.append((1000 + i, int(i % 4 == 0)))
    docs, labels = corpus(rows), spark.createDataFrame([*marks, (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.toxicity.score for r in toxicity.score_documents(docs, model).collect()}
    right = sum((got[i] >= 0.7) == bool(t) for i, t in marks)
    assert right >= 0.95 * len(marks)
    long = " ".join(calm * 300) + " grobnak"
    scored = toxicity.score_documents(corpus([(1, long)]).unionByName(odd), model).collect()
    by_text = {(r.doc_id, r.text): r.toxicity for r in scored}
    assert by_text[1, long].score >= 0.7 and by_text[1, long].worst_word > 8000
    assert by_text[0, None].score == by_text[1, ""].score == 0
    assert toxicity.train(empty, labels) is None
    assert {r.toxicity.score for r in toxicity.score_documents(odd, None).collect()} == {0.0}


# --- personal data --------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            odd_sum = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and odd_sum % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789..@@ab- +()Z%1١é") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("4111 1111-1111 1111", "+1 (974) 555-3436 x", "0255.1.2.003", "a@b@c.d", "a@b.c@d.e"):
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@b.c", "1." * 100_000, "+1" + "(" * 200_000, "@a" * 100_000):
        pii.base_spans(text)


def test_decoding_and_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    text = "ab 12-34 @x 5678"
    lat = pii.lattice(text, 0, 16)
    weights = rng.normal(0, 0.4, (pii.FEATURES, 4))
    scores = pii.segment_scores(lat, weights)

    def segmentations(i):
        if i == len(lat.atoms):
            yield []
            return
        yield from segmentations(i + 1)
        for s, (a, b) in enumerate(lat.segments):
            if a == i:
                for k in range(4):
                    for rest in segmentations(b):
                        yield [(s, k), *rest]

    every = list(segmentations(0))
    totals = np.array([sum(scores[s, k] for s, k in e) for e in every])
    best = every[int(totals.argmax())]
    want = [(pii.KINDS[k], lat.atoms[lat.segments[s][0]][0], lat.atoms[lat.segments[s][1] - 1][1]) for s, k in best]
    assert pii.decode(text, 0, 16, weights) == want
    share = np.exp(totals - np.logaddexp.reduce(totals))
    direct = np.zeros_like(scores)
    for e, p in zip(every, share, strict=True):
        for s, k in e:
            direct[s, k] += p
    assert np.allclose(pii.marginals(lat, scores), direct)


def test_spans_are_found_and_redacted(corpus, odd, empty):
    texts = [f"text number {i} mail bob{i}@site{i}.org and call +1 (20{i % 10}) 555-01{10 + i} end" for i in range(40)]
    docs = corpus([(100 + i, t, "en", "s", 0) for i, t in enumerate(texts)])
    weights = pii.train(docs)
    base, added = pii.find("call (201) 555-0199 now", weights)
    assert base == [] and added == [("phone", 5, 19)]
    out = pii.redact_documents(docs.unionByName(odd), weights)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r.n_chars is None if r.text is None else r.n_chars == len(r.text)
        if r.doc_id and r.doc_id >= 100:
            assert "[EMAIL]" in r.text and "[PHONE]" in r.text and "@" not in r.text
    assert pii.redact("ab +1 2 cd", [("phone", 3, 7), ("card", 4, 7)]) == "ab [PHONE] cd"
    found = {r.doc_id: r.pii for r in pii.detect_documents(odd, None).collect()}
    assert found[0].spans == "" and found[0].redacted is None
    assert pii.detect_documents(empty, pii.train(empty)).count() == 0


def _card(rng):
    digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(digits + str(c) for c in range(10) if pii.luhn(digits + str(c)))


def _entity(kind, rng):
    return {
        "email": f"{rng.choice(['ana.lima', 'bob_77', 'kv'])}@{rng.choice(['shop.example.org', 'my-site.co'])}",
        "ip": ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": _card(rng),
        "phone": f"+{rng.choice((1, 49))} ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}",
    }[kind]


def test_rewritten_entities_are_found_and_decoys_are_not(corpus):
    """Learnt from plain entities of other names and hosts; base spans find none of these."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        plain = f"user{i}@mail{i}.com", _entity("ip", rng), _entity("card", rng), _entity("phone", rng)
        rows += [(4 * i + k, f"zelo miran {p} tavu {i} korel", "en", "s", 0) for k, p in enumerate(plain)]
    weights = pii.train(corpus(rows))
    frames = ("write to {} before noon", "{} tela", "mir: {}", "from ({}) and on")
    for kind in pii.KINDS:
        wanted = right = 0
        for _ in range(20):
            piece = _entity(kind, rng)
            for other in pii.rewritings(kind, piece):
                frame = rng.choice(frames)
                at = frame.index("{}")
                wanted += 1
                right += (kind, at, at + len(other)) in sum(pii.find(frame.format(other), weights), [])
            for decoy in pii._decoys(kind, piece):
                assert pii.find(f"vel {decoy} mik", weights)[1] == [], decoy
        assert right >= 0.9 * wanted, (kind, right, wanted)
    for clean in ("version 4.1 of 2024, page 12", "at (12) noon 3 x 4", "look at [3] dot", "x" * 2000 + "@", "1,234,567.89"):
        assert pii.find(clean, weights) == ([], []), clean


def test_neighbourhoods_hold_whole_words():
    local = "first.middle.last-and-more.names_9"
    text = f"say {local}@host.example.org now " + "z" * 400 + " 12345"
    (a, b), *_ = pii.neighbourhoods(text)
    assert a <= text.index(local) and b >= text.index(" now")
    for long in ("1" * 100_000, "a" * 100_000 + "@" + "b" * 100_000, "a@" * 50_000, "(at) " * 20_000):
        found = pii.neighbourhoods(long)
        assert all(x < y for x, y in found) and all(p[1] <= q[0] for p, q in zip(found, found[1:], strict=False))


# --- quality classifier ---------------------------------------------------------------------


def test_sites_shrink_toward_the_corpus(spark):
    rows = []
    for host, n, rate in (("good", 200, 2.0), ("bad", 200, -2.0), ("tiny", 1, -2.0)):
        rows += [(i, host, "a" if i % 2 else None, rate if i % 5 else -rate) for i in range(n)]
    scored = spark.createDataFrame([*rows, (1, None, None, 0.0)], "doc_id long, host string, path string, evidence double")
    got = quality_model.combine(scored)
    assert got.count() == len(rows) + 1
    by_host = {r.host: r.m for r in got.groupBy("host").agg(F.avg("host_posterior").alias("m")).collect()}
    assert by_host["bad"] < by_host["tiny"] < by_host["good"]
    up = got.filter("host = 'good' and evidence > 0").first()
    assert up.score > 1 / (1 + np.exp(-up.evidence))


def test_posteriors_match_their_formula(spark):
    rows = [(i, "h" if i % 3 else "g", "p" if i % 2 else "q", (i % 7) - 3.0) for i in range(60)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")
    got = {r.doc_id: r for r in quality_model.combine(scored).collect()}
    p = {i: 1 / (1 + np.exp(-e)) for i, _, _, e in rows}
    mean = np.mean(list(p.values()))
    for level, key in (("host", lambda r: r[1]),):
        groups = {}
        for r in rows:
            groups.setdefault(key(r), []).append(p[r[0]])
        spread = sum(len(g) * (np.mean(g) - mean) ** 2 for g in groups.values())
        chance = len(groups) * mean * (1 - mean)
        between = max(0, (spread - chance) / len(rows))
        k = np.clip(mean * (1 - mean) / between - 1, *quality_model.PRIORS) if between else quality_model.PRIORS[1]
        for r in rows:
            g = groups[key(r)]
            want = (sum(g) - p[r[0]] + k * mean) / (len(g) - 1 + k)
            assert got[r[0]][f"{level}_posterior"] == pytest.approx(want, rel=1e-6)


def test_quality_of_odd_tables(odd, empty, spark):
    labels = spark.createDataFrame([(4, 0), (6, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    sites = quality_model.sites_of_pages(
        spark.createDataFrame([(1, "http://h.org/en/6?x=1"), (2, None), (3, "http://h.org/about")], "page_id long, url string")
    )
    assert [tuple(r) for r in sites.collect()] == [(6, "h.org", "en")]
    model = quality_model.train(odd, labels)
    got = quality_model.classify(odd, sites, model)
    assert got.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert quality_model.classify(empty, sites, None).count() == 0


def test_plain_tags_are_read_without_the_patterns_of_the_parser(monkeypatch):
    """Tags without attributes take a short way, with the lines of the long one."""
    import random
    from html.parser import HTMLParser

    from parcelwatch.llm import html_text

    class LongWay(html_text.LineReader):
        def parse_starttag(self, i):
            return -1 if self._endless(i) else HTMLParser.parse_starttag(self, i)

        parse_endtag = HTMLParser.parse_endtag

    def lines(reader, page):
        reader.feed(page)
        reader.close()
        return reader.lines()

    looked, plain = [], HTMLParser.check_for_whole_start_tag
    monkeypatch.setattr(HTMLParser, "check_for_whole_start_tag", lambda self, i: looked.append(i) or plain(self, i))
    page = "<html><body><nav><a>menu</a></nav><article><P>one<p>two <b>three</b></article></body></html>"
    short = lines(html_text.LineReader(), page)
    assert not looked
    assert short == lines(LongWay(), page) and len(looked) == 8
    bits = [f"<{t}>" for t in "p P a b nav article script STYLE title textarea br img li td button svg noscript x1 x-y".split()]
    bits += [b.replace("<", "</") for b in bits] + ["<p class=ad>", "<a href='x>y'>", "<p/>", "<br />", "</p x>", "</ p>", "<p", "</p", "<", ">", "</>", "<!--", "-->"]
    bits += ["word ", "&amp;", "&lt;p> ", "\n"] * 8
    rng = random.Random(4)
    for _ in range(3000):
        page = "".join(rng.choices(bits, k=rng.randrange(1, 30)))
        assert lines(html_text.LineReader(), page) == lines(LongWay(), page), page


def test_windows_are_scored_without_arrays_for_each_step(monkeypatch):
    """The states of learning and of scoring are the same; scoring one slice allocates a few arrays, not some a step."""
    rng = np.random.default_rng(0)
    net = toxicity.new_network(*(rng.normal(0, 1, n).astype(np.float32) for n in (5, 7)))
    n, h = 300, toxicity.HIDDEN
    mask = rng.random((toxicity.WINDOW, n)) < 0.8
    mask[3] = True
    projected = rng.normal(0, 1, (toxicity.WINDOW, 3 * h, n)).astype(np.float32)
    for side in "fb":
        states = np.empty((toxicity.WINDOW, h, n), np.float32)
        toxicity.run_through(net, side, projected.__getitem__, mask, states)
        assert (states == toxicity.recur(net, side, projected.__getitem__, mask)).all()
    used = []
    monkeypatch.setattr(toxicity, "_sigmoid", lambda x: used.append(x.shape))  # makes three arrays a step
    assert len(toxicity.logits_of(net, projected.__getitem__, projected.__getitem__, mask)) == n
    assert not used
