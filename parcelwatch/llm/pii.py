"""Personal data: fixed patterns, and a semi-Markov conditional random field beside them.

The patterns find the base spans, which always stay. The field reads the neighbourhoods of
digits, at-signs and bracketed "at" as sequences of atoms (letters, digits, single signs) and
scores whole candidate segments: their shape, length, digits, separators, checks and
surroundings. Entities are bounded to `MAX_ATOMS` atoms and `MAX_CHARS` characters; a dynamic
programme chooses boundaries and kinds together, and its spans that touch no base span are added.
It is trained by maximum likelihood (forward and backward sums over all segmentations) on a
bounded sample of neighbourhoods labelled by the patterns, on variants of them that the patterns
miss (addresses with a spelt-out or spaced at-sign, bracketed dots in ip addresses, cards with
other separators, phones without a plus) and on decoys that look alike and are no entity (cards
whose check digit is wrong, ip parts beyond 255).

Defined cases: a null text has no spans; texts are read whole and every step is linear in their
length; overlapping base spans of different kinds all stay and are redacted as one; repeated
rows are treated each; other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import free_name, prepare

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Each pattern starts where its leftmost match would; possessive repeats keep them linear.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT_MARK = re.compile(r"@|[(\[{] ?at ?[)\]}]", re.IGNORECASE)
_DOT_MARK = re.compile(r"[(\[{] ?(?:\.|dot) ?[)\]}]", re.IGNORECASE)
_SPELT_AT = re.compile(rf"\s?(?:{_AT_MARK.pattern})\s?", re.IGNORECASE)
_SPELT_DOT = re.compile(rf"\s?{_DOT_MARK.pattern}\s?", re.IGNORECASE)
_MORE = re.compile(rf"[A-Za-z0-9-]|\.[A-Za-z0-9]|{_SPELT_DOT.pattern}", re.IGNORECASE)  # an address goes on
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,12}")
_TRIGGER = re.compile(r"[0-9]|" + _AT_MARK.pattern, re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[Span]:
    """The pattern spans by kind, then start; ends are exclusive, in code points."""
    if not text or not _TRIGGER.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in m[0].split(".")) and all(
            int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")
        ):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[Span]) -> str:
    """Spans as kind:start:end, by kind as listed, then by start."""
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


# --- neighbourhoods and segments ------------------------------------------------------------

MAX_ATOMS = 16
MAX_CHARS = 320  # the longest address there is
REACH = 24  # characters around a digit or at-sign (after one: twice as many), then to the end of the word
FEATURES = 1 << 12
# A spelt-out or bracketed sign is one atom with the blanks beside it.
_ATOM = re.compile(r"\s?[(\[{] ?(?:at|dot|\.) ?[)\]}]\s?|[A-Za-z]+|[0-9]+|\s+|.", re.DOTALL | re.IGNORECASE)


def neighbourhoods(text: str) -> list[tuple[int, int]]:
    """Where digits and at-signs are, with some words around; near ones are one.

    A word is followed for `MAX_CHARS` characters at most, and no character twice to the same side.
    """
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        beyond = REACH if m[0].isdigit() else 2 * REACH  # hosts may be spelt out
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + beyond)
        before = out[-1][1] if out else 0
        if b <= before:
            continue
        far = max(before, m.start() - MAX_CHARS)
        while a > far and not text[a - 1].isspace():
            a -= 1
        b = max(b, before)
        far = min(len(text), m.end() + MAX_CHARS)
        while b < far and not text[b].isspace():
            b += 1
        if out and a <= before:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def atoms(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _ATOM.finditer(text, start, end)]


def _shape(piece: str) -> str:
    """Digits as 9, letters as a; runs up to three long."""
    kinds = re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]+", "a", piece))
    return re.sub(r"\s", " ", re.sub(r"9{4,}", "9999", kinds))


def segment_features(text: str, a: int, b: int) -> list[int]:
    """Buckets of the features of the segment text[a:b], whatever its kind."""
    piece = text[a:b]
    plain = _SPELT_AT.sub("@", _SPELT_DOT.sub(".", piece))  # as it would be written plainly
    plain = re.sub("^00(?=[1-9])", "+", plain)
    digits, parts, ats = _digits(plain), plain.split("."), plain.count("@")
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    address = bool(_ADDRESS.fullmatch(plain))
    whole = not (before and before in _LOCAL) and not _MORE.match(text, b)

    def side(c: str) -> str:
        if not c:
            return "edge"
        return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c

    # Any address is like any other, whatever its letters and digits.
    shape = "address" if address else _shape(plain)
    signs = "".join(sorted(set(re.sub("[A-Za-z0-9]", "", "@" if address else plain))))
    found = {
        "bias",
        f"shape {shape[:24]}",
        f"first {shape[:2]}",
        f"last {shape[-2:]}",
        f"digits {'address' if address else min(len(digits), 20)}",
        f"enough {8 <= len(digits) <= 15} {16 <= len(digits) <= 19}",
        f"luhn {len(digits) >= 16 and luhn(digits)} {16 <= len(digits) <= 19}",
        f"ip {len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}",
        f"at {ats} {'.' in plain.partition('@')[2]}",
        f"address {address} {whole}",
        f"marks {len(plain) < len(piece)} {ats} {len(parts) == 4}",
        f"plus {plain.startswith('+')}",
        f"signs {signs[:8]}",
        f"letters {any(c.isalpha() for c in piece)}",
        f"before {side(before)}",
        f"after {side(after)}",
        f"between {side(before)} {side(after)}",
    }
    return [xxhash.xxh32_intdigest(f) % FEATURES for f in sorted(found)]


def _candidate(piece: str) -> bool:
    """Whether a segment could be an entity at all."""
    first, last = piece[0], piece[-1]
    if not (first.isalnum() or first in "+(") or not last.isalnum():
        return False
    return sum("0" <= c <= "9" for c in piece) >= 4 or bool(_AT_MARK.search(piece))


@dataclass(frozen=True)
class Lattice:
    """All candidate segments (first atom, end atom) of a neighbourhood, with their features."""

    atoms: list[tuple[int, int]]
    segments: list[tuple[int, int]]
    features: list[list[int]]


def lattice(text: str, start: int, end: int) -> Lattice:
    found = atoms(text, start, end)
    segments = [
        (i, j)
        for i in range(len(found))
        for j in range(i + 1, min(len(found), i + MAX_ATOMS) + 1)
        if found[j - 1][1] - found[i][0] <= MAX_CHARS and _candidate(text[found[i][0] : found[j - 1][1]])
    ]
    return Lattice(found, segments, [segment_features(text, found[i][0], found[j - 1][1]) for i, j in segments])


def segment_scores(lat: Lattice, weights: np.ndarray) -> np.ndarray:
    """Scores (segments x kinds), against the empty label's zero."""
    if not lat.segments:
        return np.zeros((0, len(KINDS)))
    return np.array([weights[f].sum(axis=0) for f in lat.features])


def decode(text: str, start: int, end: int, weights: np.ndarray) -> list[Span]:
    """The best segmentation: non-overlapping entities, boundaries and kinds chosen together.

    Segments are scored where they end and not kept, so memory follows the number of atoms.
    """
    found = atoms(text, start, end)
    n = len(found)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i in range(max(0, j - MAX_ATOMS), j):
            a, b = found[i][0], found[j - 1][1]
            if b - a > MAX_CHARS or not _candidate(text[a:b]):
                continue
            scores = weights[segment_features(text, a, b)].sum(axis=0)
            k = int(scores.argmax())
            total = best[i] + float(scores[k])
            if total > best[j]:
                best[j], back[j] = total, (i, k)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((KINDS[k], found[i][0], found[j - 1][1]))
            j = i
    return out[::-1]


# --- learning -------------------------------------------------------------------------------

SAMPLE = 1500  # neighbourhoods, at most about so many
REWRITTEN = 1500  # variants of them
SAMPLE_ATOMS = 200  # longer neighbourhoods are not learnt from
EPOCHS, RATE, L2 = 6, 0.5, 1e-3


def _gold(lat: Lattice, spans: list[Span]) -> dict[int, int]:
    """Segment number to kind number; of overlapping spans the longer ones."""
    where = {(lat.atoms[i][0], lat.atoms[j - 1][1]): s for s, (i, j) in enumerate(lat.segments)}
    out, used = {}, []
    for kind, a, b in sorted(spans, key=lambda s: (s[1] - s[2], s[1])):
        if (a, b) in where and all(b <= x or y <= a for x, y in used):
            out[where[a, b]] = KINDS.index(kind)
            used.append((a, b))
    return out


def marginals(lat: Lattice, scores: np.ndarray) -> np.ndarray:
    """Probabilities (segments x kinds) that the segment is an entity of the kind."""
    n = len(lat.atoms)
    mass = np.logaddexp.reduce(scores, axis=1)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j) in enumerate(lat.segments):
        by_end[j].append(s)
        by_start[i].append(s)
    for j in range(1, n + 1):
        ways = [forward[j - 1]] + [forward[lat.segments[s][0]] + mass[s] for s in by_end[j]]
        forward[j] = np.logaddexp.reduce(ways)
    for i in range(n - 1, -1, -1):
        ways = [backward[i + 1]] + [backward[lat.segments[s][1]] + mass[s] for s in by_start[i]]
        backward[i] = np.logaddexp.reduce(ways)
    ends = np.array(lat.segments)
    outside = forward[ends[:, 0]] + backward[ends[:, 1]] - forward[n]
    return np.exp(np.clip(scores + outside[:, None], -700, 0))


def rewritings(kind: str, piece: str) -> list[str]:
    """Ways to write an entity that its pattern misses."""
    if kind == "email":
        local, _, host = piece.partition("@")
        spelt = host.replace(".", " (dot) ")
        return [
            f"{local} @ {host}", f"{local} (at) {host}", f"{local}[at]{host}",
            f"{local} (at) {spelt}", f"{local} [at] {host.replace('.', '[.]')}",
        ]
    if kind == "ip":
        return [piece.replace(".", "[.]"), piece.replace(".", "(.)"), piece.replace(".", "[dot]")]
    digits = _digits(piece)
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [sign.join(fours) for sign in (".", "/", "_", " - ")]
    national = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", piece)
    out = ["00" + piece[1:]] if len(digits) >= 10 else []
    if len(digits) >= 10 and not piece[1:].isdigit() and len(_digits(national)) == 10 and national[0] != " ":
        out.append(national)
    return out


def _decoys(kind: str, piece: str) -> list[str]:
    """Things written like the rewritings that are no entity."""
    if kind == "ip":
        parts = piece.split(".")
        return [mark.join([*parts[:3], f"{300 + int(parts[3]) % 600}"]) for mark in ("[.]", "(.)")]
    if kind == "card":
        digits = _digits(piece)
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + int(digits[0]) % 9) % 10)
        return rewritings(kind, wrong)
    return []


def variants(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """The text with one entity rewritten, or a decoy in the place of it; each with its spans.

    All rewritings of an entity, and one decoy, chosen by its hash.
    """
    out = []
    for kind, a, b in spans:
        piece = text[a:b]
        decoys = _decoys(kind, piece)
        some = [decoys[xxhash.xxh32_intdigest(piece) % len(decoys)]] if decoys else []
        for other, real in [(o, True) for o in rewritings(kind, piece)] + [(o, False) for o in some]:
            made, end = text[:a] + other + text[b:], a + len(other)
            rest = [s for s in base_spans(made) if s[2] <= a or end <= s[1]]
            out.append((made, [*rest, (kind, a, end)] if real else rest))
    return out


def fit(pieces: list[str]) -> np.ndarray:
    """Weights (features x kinds) learnt from neighbourhoods, labelled by the patterns."""
    found = [(text, base_spans(text)) for text in pieces]
    made = {v[0]: v for text, spans in found for v in variants(text, spans)}
    chosen = sorted(made, key=lambda t: (xxhash.xxh64_intdigest(t), t))[:REWRITTEN]
    examples = []
    for text, wanted in found + [made[t] for t in chosen]:
        lat = lattice(text, 0, len(text))
        if lat.segments:
            examples.append((lat, _gold(lat, wanted)))
    weights = np.zeros((FEATURES, len(KINDS)))
    weights[xxhash.xxh32_intdigest("bias") % FEATURES] = -2.0
    grown = np.full_like(weights, 1e-6)
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for e in rng.permutation(len(examples)):
            lat, gold = examples[e]
            error = -marginals(lat, segment_scores(lat, weights))
            for s, k in gold.items():
                error[s, k] += 1
            some = np.flatnonzero(np.abs(error).max(axis=1) > 1e-4)
            if not len(some):
                continue
            step = np.zeros_like(weights)
            for s in some:
                step[lat.features[s]] += error[s]
            rows = np.flatnonzero(step.any(axis=1))
            step = step[rows] - L2 * weights[rows]
            grown[rows] += step * step
            weights[rows] += RATE * step / np.sqrt(grown[rows])
    return weights


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Weights from a bounded sample of the neighbourhoods of digits and at-signs in `docs`.

    Neighbourhoods with a base span and those without are drawn alike, by their hash.
    """
    text = F.col(f"`{text_col}`").alias("text")
    some = docs.select(text).filter(F.col("text").rlike("[0-9@]"))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [t[a:b] for t in part["text"] for a, b in neighbourhoods(t) if b - a <= 20 * REACH]
            yield pd.DataFrame({"piece": found, "hit": [bool(base_spans(p)) for p in found]})

    pieces = some.mapInPandas(cut, "piece string, hit boolean").distinct()
    draw = F.xxhash64("piece").alias("draw")
    rows = []
    for hit in (True, False):  # the smallest hashes of each: a fixed number of short strings
        wanted = pieces.filter(F.col("hit") == hit).select("piece", draw)
        rows += wanted.orderBy("draw", "piece").limit(SAMPLE // 2).collect()
    found = sorted(r.piece for r in rows)
    return fit([p for p in found if len(atoms(p, 0, len(p))) <= SAMPLE_ATOMS])


# --- finding and redacting ------------------------------------------------------------------


def find(text: str | None, weights: np.ndarray | None) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text."""
    base = base_spans(text)
    if weights is None or not text:
        return base, []
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for a, b in neighbourhoods(text):
        for kind, x, y in decode(text, a, b, weights):
            if all(y <= s or e <= x for s, e in taken):
                added.append((kind, x, y))
    return base, added


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "base string, spans string, n_email long, n_ip long, n_card long, n_phone long, redacted string"


def detect(text: Column, weights: np.ndarray | None) -> Column:
    """A struct: base spans, all spans, base counts a kind, the text without all of them."""

    def one(t: str | None):
        base, added = find(t, weights)
        counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
        return (joined(base), joined(base + added), *counts, t if t is None else redact(t, base + added))

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pd.DataFrame([one(t) for t in texts], columns=names)

    return run.asNondeterministic()(text)


def detect_documents(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", into: str = "pii") -> DataFrame:
    prepare(docs.sparkSession)
    return docs.withColumn(into, detect(F.col(f"`{text_col}`"), weights))


def redact_documents(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """`docs` with personal data replaced in the text, and the length brought up to date."""
    name = free_name(docs, "pii")
    found = detect_documents(docs, weights, text_col, name).withColumn(text_col, F.col(f"{name}.redacted"))
    if length_col in docs.columns:
        found = found.withColumn(length_col, F.length(F.col(f"`{text_col}`")).cast("long"))
    return found.drop(name)
