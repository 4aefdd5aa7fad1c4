"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as the embedding of the word, if it is in the learnt vocabulary, beside the
mean embedding of its hashed character n-grams; both start from how toxic their
labelled documents are. Overlapping windows of `WINDOW` words, one from each word on, run
through a forward and a backward network; attention pools the states of a window and gives its
logit. A document is as toxic as its worst window, and all windows of the whole text are scored:
words before or after a passage add windows and take none away, so they never lower a score.
Windows that begin at neighbouring words take their step t from neighbouring words too, so a step
of many windows is one stretch of the text's projected words, shifted by t.

Learning uses a bounded sample: about `PER_CLASS` labelled documents a class; documents of more
than `SAMPLE_CHARS` characters are not learnt from. Windows from every `LEARN_STRIDE`th word first
take the label of their document, then the network itself names the guilty windows of toxic
documents and the hardest ones of clean documents. Where scores pass `THRESHOLD` is set by all
windows of documents left out of the learning.

Defined cases: null and empty texts and texts without a letter or digit score 0; with no labels
of one of the classes everything scores 0; repeated rows are scored each; a document with
several labels counts as toxic if one says so; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import bounded_sample, prepare, slices

WINDOW, LEARN_STRIDE = 12, 6
HIDDEN, ATTENTION = 6, 6
WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 4, 4, 1 << 13
GRAMS = (3, 5)
SHRINK = 4.0  # documents that an n-gram or word must outweigh before it is evidence
MIN_DOCUMENTS = 4  # a word must occur in so many sampled documents to be in the vocabulary
PER_CLASS = 1500
SAMPLE_CHARS = 20_000
THRESHOLD = 0.7
SLICE = 4096  # windows at a time
SLICE_WORDS = 1 << 18  # of texts laid out at a time; a longer text is a slice of its own
CACHE = 200_000  # words whose input projections a worker remembers

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def windows(ids: np.ndarray) -> np.ndarray:
    """Words of the windows that are learnt from; 0 where a text is shorter than a window."""
    if not len(ids):
        return np.zeros((0, WINDOW), np.int64)
    padded = np.r_[ids, np.zeros(max(0, WINDOW - len(ids)), np.int64)]
    starts = np.r_[np.arange(0, len(padded) - WINDOW, LEARN_STRIDE), len(padded) - WINDOW]
    return padded[starts[:, None] + np.arange(WINDOW)]


def laid_out(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with words one after the other, short ones filled up to a window with 0.

    Returns the words, the number of windows of each text (0: no words) and where its first starts.
    """
    sizes = np.array([len(i) for i in ids], np.int64)
    widths = np.where(sizes > 0, np.maximum(sizes, WINDOW), 0)
    starts = np.cumsum(widths) - widths
    words = np.zeros(int(widths.sum()), np.int64)
    inside = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    words[inside] = np.concatenate([np.zeros(0, np.int64), *ids])
    return words, np.where(sizes > 0, widths - WINDOW + 1, 0), starts


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams, ends included, and how many each word has."""
    framed = "".join(f"^{w}$" for w in words)
    points = np.frombuffer(framed.encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owners, buckets = [], []
    for n in GRAMS:
        at = np.flatnonzero(word[: max(0, len(word) - n + 1)] == word[n - 1 :])
        key = np.full(len(at), n, np.uint32)
        for i in range(n):
            key = (key ^ points[at + i]) * np.uint32(0x85EBCA6B)
            key ^= key >> np.uint32(13)
        owners.append(word[at])
        buckets.append(key % np.uint32(CHAR_BUCKETS))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), np.bincount(owner, minlength=len(words))


# --- the network ----------------------------------------------------------------------------
# Arrays are feature-major: a step of all windows is (features, windows).


def new_network(word: np.ndarray, char: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Random weights over the given evidence of words and of n-grams (row 0: none)."""
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN

    def normal(*shape, scale=0.4):
        return rng.normal(0, scale, shape).astype(np.float32)

    net = {
        "word": normal(len(word), WORD_DIM, scale=0.02),
        "char": normal(len(char), CHAR_DIM, scale=0.02),
        "wa": normal(ATTENTION, 2 * h),
        "ba": np.zeros(ATTENTION, np.float32),
        "va": normal(ATTENTION),
        "wo": normal(2 * h),
        "bo": np.zeros(1, np.float32),
    }
    net["word"][:, 0] = word
    net["char"][:, 0] = char
    net["word"][0] = 0
    for side in "fb":
        net[f"w{side}"] = normal(3 * h, d)
        net[f"u{side}"] = normal(3 * h, h)
        net[f"b{side}"] = np.zeros(3 * h, np.float32)
    return net


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _steps(side: str) -> range:
    return range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)


def recur(net, side: str, gates, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """States (window, hidden, n) of one direction; `gates(t)` has the projected inputs.

    `trace` takes what the gradient needs.
    """
    h, u = HIDDEN, net[f"u{side}"]
    state = np.zeros((h, mask.shape[1]), np.float32)
    states = np.empty((WINDOW, *state.shape), np.float32)
    whole = mask.all(axis=1)
    for t in _steps(side):
        past, now = u @ state, gates(t)
        open_ = _sigmoid(now[: 2 * h] + past[: 2 * h])
        reset, update = open_[:h], open_[h:]
        new = np.tanh(now[2 * h :] + reset * past[2 * h :])
        mixed = new + update * (state - new)
        if trace is not None:
            trace[t] = (state, past[2 * h :], reset, update, new)
        state = mixed if whole[t] else np.where(mask[t], mixed, state)
        states[t] = state
    return states


def run_through(net, side: str, gates, mask: np.ndarray, states: np.ndarray) -> None:
    """The states of `recur`, by the same arithmetic, into `states`: nothing is allocated a step."""
    h, u = HIDDEN, net[f"u{side}"]
    n = mask.shape[1]
    state, past, new = (np.zeros((rows, n), np.float32) for rows in (h, 3 * h, h))
    reset, update, open_ = past[:h], past[h : 2 * h], past[: 2 * h]
    whole = mask.all(axis=1)
    for t in _steps(side):
        now, mixed = gates(t), states[t]
        np.matmul(u, state, out=past)
        open_ += now[: 2 * h]
        open_ *= np.float32(0.5)
        np.tanh(open_, out=open_)
        open_ *= np.float32(0.5)
        open_ += np.float32(0.5)
        np.multiply(reset, past[2 * h :], out=new)
        new += now[2 * h :]
        np.tanh(new, out=new)
        np.subtract(state, new, out=mixed)
        mixed *= update
        mixed += new
        if not whole[t]:
            np.copyto(mixed, state, where=~mask[t])
        state = mixed


def attend(net, states: np.ndarray, mask: np.ndarray):
    scored = net["wa"] @ states
    scored += net["ba"][:, None]
    np.tanh(scored, out=scored)
    e = np.where(mask, np.einsum("a,tan->tn", net["va"], scored), np.float32(-1e9))
    e -= e.max(axis=0)
    share = np.exp(e, out=e)
    share /= share.sum(axis=0)
    pooled = np.einsum("tn,thn->hn", share, states)
    return net["wo"] @ pooled + net["bo"][0], (scored, share, pooled)


def logits_of(net, forward, backward, mask: np.ndarray) -> np.ndarray:
    """Window logits from the two directions' projected inputs."""
    states = np.empty((WINDOW, 2 * HIDDEN, mask.shape[1]), np.float32)
    run_through(net, "f", forward, mask, states[:, :HIDDEN])
    run_through(net, "b", backward, mask, states[:, HIDDEN:])
    return attend(net, states, mask)[0]


def projected_logits(net, f: np.ndarray, b: np.ndarray, wins: np.ndarray) -> np.ndarray:
    """Window logits, given the projections of each word (row) and the words of each window."""
    out = np.empty(len(wins), np.float32)
    for i in range(0, len(wins), SLICE):
        part = np.ascontiguousarray(wins[i : i + SLICE].T)

        def gates(t, table, part=part):
            return table.take(part[t], 0).T

        out[i : i + SLICE] = logits_of(
            net, lambda t, g=gates: g(t, f), lambda t, g=gates: g(t, b), part > 0
        )
    return out


def sliding_logits(net, f: np.ndarray, b: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Logits of the windows from every word but the last ones, given projections of each word (row)."""
    out = np.empty(max(0, len(words) - WINDOW + 1), np.float32)
    for i in range(0, len(out), SLICE):
        n = min(SLICE, len(out) - i)
        part = words[i : i + n + WINDOW - 1]
        forward, backward = (np.ascontiguousarray(table.take(part, 0).T) for table in (f, b))
        known = np.lib.stride_tricks.sliding_window_view(part > 0, n)
        out[i : i + n] = logits_of(
            net, lambda t, p=forward, n=n: p[:, t : t + n], lambda t, p=backward, n=n: p[:, t : t + n], known
        )
    return out


def worst_windows(net, f: np.ndarray, b: np.ndarray, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the highest logit of all its windows and the word it starts at (-1: no words)."""
    words, counts, starts = laid_out(ids)
    logit = sliding_logits(net, f, b, words)
    worst, at = np.full(len(ids), -np.inf), np.full(len(ids), -1, np.int64)
    for i in np.flatnonzero(counts):
        own = logit[starts[i] : starts[i] + counts[i]]  # not those that reach into the next text
        at[i] = own.argmax()
        worst[i] = own[at[i]]
    return worst, at


def gradients(net, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
    """Mean log-loss gradients of all dense weights, and of the inputs x (window, dim, n)."""
    h, traces = HIDDEN, {"f": {}, "b": {}}

    def gates(side):
        return lambda t: net[f"w{side}"] @ x[t] + net[f"b{side}"][:, None]

    states = np.concatenate([recur(net, s, gates(s), mask, traces[s]) for s in "fb"], axis=1)
    logit, (scored, share, pooled) = attend(net, states, mask)
    d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    g = {"wo": pooled @ d, "bo": d.sum(keepdims=True)}
    d_pool = net["wo"][:, None] * d
    d_share = np.einsum("hn,thn->tn", d_pool, states)
    d_e = share * (d_share - (share * d_share).sum(axis=0))
    g["va"] = np.einsum("tn,tan->a", d_e, scored)
    d_pre = net["va"][:, None] * d_e[:, None] * (1 - scored * scored)
    g["wa"] = np.einsum("tan,thn->ah", d_pre, states)
    g["ba"] = d_pre.sum(axis=(0, 2))
    d_states = share[:, None] * d_pool + net["wa"].T @ d_pre
    d_x = np.zeros_like(x)
    for side, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
        u, w = net[f"u{side}"], net[f"w{side}"]
        d_u, d_w, d_b = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * h, np.float32)
        d_next = np.zeros((h, len(y)), np.float32)
        for t in reversed(_steps(side)):
            state, past_new, reset, update, new = traces[side][t]
            d_state = d_states[t, part] + d_next
            inner = np.where(mask[t], d_state, 0)
            d_new = inner * (1 - update) * (1 - new * new)
            d_update = inner * (state - new) * update * (1 - update)
            d_reset = d_new * past_new * reset * (1 - reset)
            d_gates = np.concatenate([d_reset, d_update, d_new])
            d_past = np.concatenate([d_reset, d_update, d_new * reset])
            d_u += d_past @ state.T
            d_w += d_gates @ x[t].T
            d_b += d_gates.sum(axis=1)
            d_x[t] += w.T @ d_gates
            d_next = np.where(mask[t], inner * update, d_state) + u.T @ d_past
        g[f"u{side}"], g[f"w{side}"], g[f"b{side}"] = d_u, d_w, d_b
    return g, d_x


# --- learning -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    vocabulary: dict[str, int]
    net: dict[str, np.ndarray]
    slope: float
    cut: float  # the logit that scores exactly THRESHOLD


class _Lexicon:
    """Numbers for the words of a sample: vocabulary entry and n-grams of each."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.number = vocabulary, {"": 0}

    def ids(self, words: list[str]) -> np.ndarray:
        number = self.number
        return np.array([number.setdefault(w, len(number)) for w in words], np.int64)

    def freeze(self) -> None:
        known = list(self.number)
        self.entries = np.array([self.vocabulary.get(w, 0) for w in known])
        self.flat, self.sizes = char_grams(known)
        self.first = np.cumsum(self.sizes) - self.sizes

    def grams(self, ids: np.ndarray) -> set[int]:
        return {int(b) for i in ids for b in self.flat[self.first[i] : self.first[i] + self.sizes[i]]}

    def inputs(self, net, ids: np.ndarray):
        """Input vectors of distinct word numbers, and where their n-grams are."""
        size = self.sizes[ids]
        owner = np.repeat(np.arange(len(ids)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[ids], size)
        buckets = self.flat[at]
        mean = np.zeros((len(ids), CHAR_DIM), np.float32)
        np.add.at(mean, owner, net["char"][buckets])
        mean /= np.maximum(size, 1)[:, None]
        return np.concatenate([net["word"][self.entries[ids]], mean], axis=1), (owner, buckets, size)


def _train_on(net, grown, lexicon, some: np.ndarray, y: np.ndarray) -> None:
    """One Adagrad step on some windows."""
    ids, where = np.unique(some, return_inverse=True)
    vectors, (owner, buckets, size) = lexicon.inputs(net, ids)
    where = where.reshape(some.shape)
    x = np.ascontiguousarray(vectors[where].transpose(1, 2, 0))
    g, d_x = gradients(net, x, some.T > 0, y)
    d_vectors = np.zeros_like(vectors)
    np.add.at(d_vectors, where.ravel(), d_x.transpose(2, 0, 1).reshape(-1, vectors.shape[1]))
    g["word"], g["char"] = np.zeros_like(net["word"]), np.zeros_like(net["char"])
    np.add.at(g["word"], lexicon.entries[ids], d_vectors[:, :WORD_DIM])
    g["word"][0] = 0
    np.add.at(g["char"], buckets, (d_vectors[:, WORD_DIM:] / np.maximum(size, 1)[:, None])[owner])
    for name, d in g.items():
        rate = 0.005 if name in ("word", "char") else 0.05
        grown[name] += d * d
        net[name] -= rate * d / np.sqrt(grown[name] + 1e-8)


def _projections(net, lexicon) -> list[np.ndarray]:
    """Of all words of a sample, for both directions."""
    vectors, _ = lexicon.inputs(net, np.arange(len(lexicon.entries)))
    return [vectors @ net[f"w{s}"].T + net[f"b{s}"] for s in "fb"]


def evidence(features: list[set], y: np.ndarray, n: int) -> np.ndarray:
    """Of each feature the log-odds that its documents are toxic, drawn to zero where they are few."""
    seen = np.zeros((2, n))
    for found, label in zip(features, y, strict=True):
        seen[label, list(found)] += 1
    rate = seen / np.maximum(np.bincount(y, minlength=2), 1)[:, None] * len(y) / 2
    return np.log((rate[1] + SHRINK) / (rate[0] + SHRINK)).astype(np.float32)


def fit(texts: list[str], toxic: list[int], rounds: int = 3, steps: int = 100, batch: int = 192) -> Model | None:
    """A model of labelled texts; none if one of the classes is missing.

    A fifth of the documents is left out of the learning and fixes the scale of the scores.
    """
    labelled = [(w, int(y)) for w, y in zip(map(tokens, texts), toxic, strict=True) if w]
    y = np.array([v for _, v in labelled], np.int64)
    taught = np.arange(len(y)) % 5 > 0
    if not 0 < y[taught].sum() < taught.sum():
        return None
    own = [ws for (ws, _), t in zip(labelled, taught, strict=True) if t]
    seen = Counter(w for ws in own for w in set(ws))
    common = sorted(w for w, n in seen.items() if n >= MIN_DOCUMENTS)
    vocabulary = {w: i + 1 for i, w in enumerate(common)}
    lexicon = _Lexicon(vocabulary)
    ids = [lexicon.ids(ws) for ws, _ in labelled]
    lexicon.freeze()
    kinds = [{vocabulary[w] for w in ws if w in vocabulary} for ws in map(set, own)]
    word = evidence(kinds, y[taught], len(vocabulary) + 1)
    grams = [lexicon.grams(np.unique(ids[k])) for k in np.flatnonzero(taught)]
    char = evidence(grams, y[taught], CHAR_BUCKETS)
    wins = [windows(i) for i in ids]
    doc = np.repeat(np.arange(len(wins)), [len(w) for w in wins])
    wins = np.concatenate(wins)
    net = new_network(word, char)
    grown = {k: np.zeros_like(v) for k, v in net.items()}
    rng = np.random.default_rng(5)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    guilty = np.flatnonzero(taught[doc] & (y[doc] == 1))
    clean = np.flatnonzero(taught[doc] & (y[doc] == 0))
    hard = clean
    for turn in range(rounds):
        for _ in range(steps):
            picked = [rng.choice(guilty, batch // 2), rng.choice(hard, batch // 4), rng.choice(clean, batch // 4)]
            at = np.concatenate(picked)
            _train_on(net, grown, lexicon, wins[at], y[doc[at]])
        if turn < rounds - 1:  # the worst window of each document stands for it
            logit = projected_logits(net, *_projections(net, lexicon), wins)
            top = logit >= np.maximum.reduceat(logit, first)[doc]
            guilty = np.flatnonzero(taught[doc] & top & (y[doc] == 1))
            hard = np.flatnonzero(taught[doc] & top & (y[doc] == 0))
    judges = ~taught if 0 < y[~taught].sum() < (~taught).sum() else taught
    worst, _ = worst_windows(net, *_projections(net, lexicon), [ids[k] for k in np.flatnonzero(judges)])
    slope, cut = calibrate(worst, y[judges])
    return Model(vocabulary, net, slope, cut)


def calibrate(worst: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The logit that parts the classes best (by F1), and the slope of the scores around it."""
    order = np.argsort(-worst, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(len(y)) + 1 + y.sum())
    k = int(f1.argmax())
    below = worst[order[k + 1]] if k + 1 < len(y) else worst[order[k]] - 1
    cut = float((worst[order[k]] + below) / 2)
    spread = float(worst[y == 1].mean() - worst[y == 0].mean())
    return 6 / max(spread, 0.5), cut


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Model | None:
    """A model from a bounded sample of the labelled documents (`labels`: doc_id, toxic)."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = bounded_sample(known, "toxic", PER_CLASS, F.col("doc_id"))
    text = F.col(f"`{text_col}`")
    usable = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).filter(
        F.length("text") <= SAMPLE_CHARS
    )
    rows = usable.join(F.broadcast(sample), "doc_id").select("text", "toxic").collect()
    rows.sort(key=lambda r: (r.text, r.toxic))  # any order of tasks gives the same model
    return fit([r.text for r in rows], [r.toxic for r in rows])


# --- scoring --------------------------------------------------------------------------------


class Scorer:
    """Scores whole texts; remembers the input projections of the words it has met."""

    def __init__(self, model: Model):
        self.model, net = model, model.net
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count(1).__next__)
        zero = np.zeros((1, 3 * HIDDEN), np.float32)  # row 0: no word
        self.projected = {"f": zero, "b": zero}

    def _ids(self, words: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > CACHE:
            self._forget()
        known = len(self.number)
        ids = [np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws)) for ws in words]
        fresh = list(islice(self.number, known, None))  # words are numbered as they are met
        if fresh:
            net, (buckets, sizes) = self.model.net, char_grams(fresh)
            mean = np.add.reduceat(net["char"][buckets], np.cumsum(sizes) - sizes) / sizes[:, None]
            word = net["word"][[self.model.vocabulary.get(w, 0) for w in fresh]]
            x = np.concatenate([word, mean], axis=1).astype(np.float32)
            for side, rows in self.projected.items():
                new = x @ net[f"w{side}"].T + net[f"b{side}"]
                self.projected[side] = np.concatenate([rows, new])
        return ids

    def score(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the score and the first word of its worst window (-1: no words)."""
        score, first = np.zeros(len(texts)), np.full(len(texts), -1, np.int64)
        words = [tokens(t) for t in texts]
        for part in slices([len(ws) for ws in words], SLICE_WORDS):
            ids = self._ids(words[part])
            worst, first[part] = worst_windows(self.model.net, self.projected["f"], self.projected["b"], ids)
            margin = self.model.slope * (worst - self.model.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
            score[part] = np.where(first[part] < 0, 0, 1 / (1 + np.exp(-np.clip(margin, -50, 50))))
        return score, first


def score(text: Column, model: Model | None) -> Column:
    """A struct (score, worst_word) for each text."""

    @F.pandas_udf("score double, worst_word long")
    def run(texts: pd.Series) -> pd.DataFrame:
        if model is None:
            return pd.DataFrame({"score": 0.0, "worst_word": -1}, index=texts.index)
        scorer = _scorer(model)
        return pd.DataFrame(dict(zip(("score", "worst_word"), scorer.score(texts.tolist()), strict=True)))

    return run.asNondeterministic()(text)


_held: dict[str, object] = {}


def _scorer(model: Model) -> Scorer:
    """One scorer a worker, kept between batches."""
    if _held.get("model") is not model:
        _held.update(model=model, scorer=Scorer(model))
    return _held["scorer"]


def score_documents(docs: DataFrame, model: Model | None, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """`docs` with a struct column `into` (score, worst_word)."""
    prepare(docs.sparkSession)
    return docs.withColumn(into, score(F.col(f"`{text_col}`"), model))
