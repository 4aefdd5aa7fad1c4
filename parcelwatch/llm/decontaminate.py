"""Benchmark decontamination: rare n-gram seeds join documents to items, Smith-Waterman decides.

A document is contaminated by an item if their best alignment (match +1, mismatch and gap -1,
so changed, added and dropped words are tolerated) scores at least `MIN_SHARE` of the item's
length. The filters before the alignment follow from that and lose nothing: with m matches and e
errors the matches stand in at most e + 1 unbroken runs, so an alignment of score s holds s - 1
pairs of neighbouring words of the item at the least (`needed`), and as e is at most
`1 - MIN_SHARE` of the item's length, these lie on diagonals no further apart than that (`drift`).

Words are hashes, and so are pairs of neighbouring words. The pairs of all documents meet those of
the benchmark in a join; what meets is written, and counted by pair over the corpus. An item of n
pairs of which an alignment holds `needed` takes as seeds its n - needed + `seeds_wanted` rarest
pairs: whatever holds `needed` of n holds `seeds_wanted` of those. Documents and items join on
seeds, the commonest pairs start nothing, and those that share enough seeds are candidates. Each
candidate document gets the words of its items, and is aligned to them around the diagonals that
hold enough pairs.

The benchmark's pairs are counted before they are sent to all tasks: more than `BROADCAST_ROWS` are
joined by a shuffle instead, and so are the documents that are candidates. A larger benchmark costs
no more passes. A pair that many documents hold is counted on the map side, and its join is split if
it is hot.

Defined cases: words are what white space separates, without case and without signs at their
ends; items of fewer than `MIN_WORDS` words, empty or null ones are too short to be recognised and
match nothing; items of three and four words need two pairs, where one would give the score; null
and empty documents match nothing; documents are read whole; a passage common to a third of the
documents is found in each; repeated documents and items are matched each; ties between places go
to the first one; ids are of any type; other columns are carried along by `remove`.
"""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwatch.llm.common import prepare, row_keys, written

NGRAM = 2
MIN_WORDS = 3  # of an item that can be recognised
MIN_SHARE = 0.5
MIN_PAIRS = 2  # that start an alignment, also of the shortest items
SEED_SHARE = 0.5  # of the needed pairs: so many have to be seeds
CACHE = 200_000  # words whose hashes a task remembers
BROADCAST_ROWS = 1 << 22  # numbers that are sent to all tasks at most; more are joined by a shuffle

# Signs that do not belong to a word at whose ends they stand.
SIGNS = string.punctuation + "«»‹›„“”‚‘’…–—·•¿¡、。，！？「」『』"

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    plain = (w.strip(SIGNS) for w in (text or "").lower().split())
    return [w for w in plain if w]


class Words(dict):
    """Hashes of words, as positive numbers, by the word as it stands in a text; -1: only signs."""

    def __missing__(self, word: str) -> int:
        plain = word.strip(SIGNS)
        self[word] = found = xxhash.xxh3_64_intdigest(plain) >> 1 if plain else -1
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        """The hashes of the words of a text: those of its `tokens`."""
        if len(self) > CACHE:
            self.clear()
        words = (text or "").lower().split()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return ids[ids >= 0]


def grams(ids: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of words."""
    n = len(ids) - NGRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for i in range(NGRAM):
        key = (key ^ ids[i : i + n].astype(np.uint64)) * _PRIME
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def needed(length: int) -> int:
    """Pairs of an item of so many words that every alignment of `MIN_SHARE` holds."""
    return max(MIN_PAIRS, ceil(MIN_SHARE * length) - 1)


def drift(length: int) -> int:
    """Diagonals over which such an alignment can spread: its errors at most."""
    return int((1 - MIN_SHARE) * length)


# --- alignment ------------------------------------------------------------------------------


def align(item: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of the item to each row of `parts` (-1: nothing there).

    Returns score, and first and end word of the aligned stretch in the row.
    """
    score, end = _best_end(item, parts)
    width = parts.shape[1]
    # the alignment read backwards from its end gives its start
    turned = np.full_like(parts, -1)
    for r, e in enumerate(end):
        turned[r, : e + 1] = parts[r, e::-1] if e >= 0 else -1
    _, back = _best_end(item[::-1], turned, np.maximum(score, 1))
    start = np.where(score > 0, end - back, 0)
    return score, np.clip(start, 0, width), end + 1


def _best_end(item: np.ndarray, parts: np.ndarray, until: np.ndarray | None = None):
    """Highest score of each row and the column where it is first reached."""
    rows, width = parts.shape
    slope = np.arange(width)
    above = np.zeros((rows, width), np.int64)
    best, end = np.zeros(rows, np.int64), np.full(rows, -1)
    for w in item:
        step = np.where(parts == w, 1, -1)
        step[parts < 0] = -1
        diagonal = step.copy()
        diagonal[:, 1:] += above[:, :-1]
        here = np.maximum(np.maximum(diagonal, above - 1), 0)
        here = np.maximum.accumulate(here + slope, axis=1) - slope  # gaps in the item
        here[parts < 0] = 0
        top = here.max(axis=1)
        better = top > best
        if better.any():
            best = np.where(better, top, best)
            end = np.where(better, here.argmax(axis=1), end)
        above = here
    return best, end


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def regions(item: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end word) of the parts of a document to align to an item, from common pairs."""
    own, length = grams(item), len(item)
    keys, places = np.unique(own, return_inverse=True)
    order = np.argsort(places, kind="stable")  # positions of each key
    first = np.searchsorted(places[order], np.arange(len(keys) + 1))
    found = grams(ids)
    key = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    at = np.flatnonzero(keys[key] == found)
    key = key[at]
    size = first[key + 1] - first[key]
    position = order[_ranges(first[key], size)]
    if len(np.unique(position)) < needed(length):
        return []
    diagonal, beside, out = np.repeat(at, size) - position, drift(length), []
    reach = 2 * length + 4 * beside
    for low, high in _bands(diagonal, position, needed(length), beside):
        start, last = max(0, low - beside), min(len(ids), high + length + beside)
        # a long run of diagonals (repeats) is read in overlapping parts
        for a in range(start, max(start + 1, last - reach // 2), reach // 2):
            out.append((a, min(last, a + reach)))
    return out


def _bands(diagonal: np.ndarray, position: np.ndarray, wanted: int, width: int) -> list[tuple[int, int]]:
    """Stretches of diagonals in which `wanted` positions are hit within `width` diagonals."""
    order = np.argsort(diagonal, kind="stable")
    diagonal, position = diagonal[order], position[order]
    near = np.flatnonzero(diagonal[wanted - 1 :] - diagonal[: len(diagonal) - wanted + 1] <= width)
    if not len(near):
        return []
    change = np.zeros(len(diagonal) + 1, np.int64)
    np.add.at(change, near, 1)
    np.add.at(change, near + wanted, -1)
    inside = np.cumsum(change[:-1]) > 0
    hits = list(zip(diagonal[inside].tolist(), position[inside].tolist(), strict=True))
    out: list[tuple[int, int]] = []
    seen: Counter[int] = Counter()
    low = 0
    for d, p in hits:
        seen[p] += 1
        while d - hits[low][0] > width:
            gone = hits[low][1]
            seen[gone] -= 1
            if not seen[gone]:
                del seen[gone]
            low += 1
        if len(seen) >= wanted:
            if out and hits[low][0] <= out[-1][1]:
                out[-1] = (out[-1][0], d)
            else:
                out.append((hits[low][0], d))
    return out


def matches(rows: list[tuple[str | None, list[tuple[int, list[int]]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, score, item words, start, end) for documents and the items that they may hold.

    `rows` are texts, each with its items as (number, word hashes). Start and end are code points
    of the stretch that aligns best; one row a text and item. Parts of several texts are aligned to
    an item side by side.
    """
    read = Words()
    ids = [read(text) for text, _ in rows]
    by_item, words = defaultdict(list), {}
    for t, (_, items) in enumerate(rows):
        for item, own in items:
            if item not in words:
                words[item] = np.array(own, np.int64)
            by_item[item] += [(t, a, b) for a, b in regions(words[item], ids[t])]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for item, parts in by_item.items():
        own = words[item]
        parts.sort(key=lambda part: part[2] - part[1])  # alike widths side by side; the first place wins
        for i in range(0, len(parts), 256):
            some = parts[i : i + 256]
            grid = np.full((len(some), max(b - a for _, a, b in some)), -1, np.int64)
            for r, (t, a, b) in enumerate(some):
                grid[r, : b - a] = ids[t][a:b]
            for (t, a, _), s, x, y in zip(some, *align(own, grid), strict=True):
                place = (-int(s), int(a + x), int(a + y))
                if s >= MIN_SHARE * len(own) and place < best.get((t, item), (0, 0, 0)):
                    best[t, item] = place
    out, spans = [], {}
    for (t, item), (s, a, b) in sorted(best.items()):
        if t not in spans:
            spans[t] = _spans(rows[t][0])
        out.append((t, item, -s, len(words[item]), spans[t][a][0], spans[t][b - 1][1]))
    return out


def _spans(text: str) -> list[tuple[int, int]]:
    """Code points of each word."""
    out = []
    for m in re.finditer(r"\S+", text):
        start = m.end() - len(m[0].lstrip(SIGNS))
        end = m.start() + len(m[0].rstrip(SIGNS))
        if start < end:
            out.append((start, end))
    return out


# --- over tables ----------------------------------------------------------------------------


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The items that can be recognised: item (a number a row), item_id, words (hashes), grams."""

    @F.pandas_udf("words array<long>, grams array<long>")
    def read(texts: pd.Series) -> pd.DataFrame:
        words = Words()
        found = [words(t) for t in texts]
        return pd.DataFrame({"words": found, "grams": [grams(w) for w in found]})

    named = F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), *named)
    items = items.withColumn("read", read("text")).select("item", "item_id", "read.*")
    return items.filter(F.size("words") >= MIN_WORDS)


def document_grams(text: Column) -> Column:
    """The distinct pairs of a document, as hashes."""

    @F.pandas_udf("array<long>")
    def read(texts: pd.Series) -> pd.Series:
        words = Words()
        return pd.Series([np.unique(grams(words(t))) for t in texts])

    return read(text)


def _sent(df: DataFrame, label: str) -> DataFrame:
    """A written table that is sent to all tasks if it is small, as counted."""
    df = written(df, label)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def seeds_of(items: DataFrame, met: DataFrame) -> DataFrame:
    """(gram, item, places, wanted): the rarest pairs of each item, at how many places they stand.

    `met` has a row for each document and pair of the benchmark in it. Pairs that no document holds
    are the rarest, and seeds too: an edited copy does not hold them, and need not.
    """
    counts = met.groupBy("gram").agg(F.count("*").alias("n"))
    places = items.select("item", F.size("words").alias("length"), F.posexplode("grams").alias("place", "gram"))
    counted = places.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "place"))  # as many rows as an item has words
    wanted = F.greatest(F.ceil(MIN_SHARE * F.col("length")) - 1, F.lit(MIN_PAIRS))
    enough = F.ceil(SEED_SHARE * wanted)
    kept = counted.withColumns({"rank": rank, "wanted": enough}).filter(
        F.col("rank") <= F.col("length") - NGRAM + 1 - wanted + enough
    )
    return kept.groupBy("gram", "item", "wanted").agg(F.count("*").alias("places"))


def candidates_of(met: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row_key, row_check, item) of documents and items that share enough seeds."""
    shared = met.join(seeds, "gram").groupBy("row_key", "row_check", "item", "wanted")
    return shared.agg(F.sum("places").alias("n")).filter("n >= wanted").drop("n", "wanted")


_FOUND = ["doc_id", "row_key", "row_check", "item", "matched", "item_words", "start", "end"]


def _search(rows: DataFrame) -> DataFrame:
    """Alignments of candidate documents (doc_id, row_key, row_check, text, items)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, items = (batch.column(i).to_pylist() for i in (3, 4))
            found = matches([(t, [(c["item"], c["words"]) for c in some]) for t, some in zip(texts, items, strict=True)])
            if found:
                row, *rest = zip(*found, strict=True)
                own = [batch.column(i).take(pa.array(row)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in rest)], _FOUND)

    kinds = dict(rows.dtypes)
    named = ", ".join(f"`{c}` {kinds[c]}" for c in _FOUND[:3])
    return rows.mapInArrow(search, named + "".join(f", `{c}` long" for c in _FOUND[3:]))


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row per contaminated document and benchmark item.

    doc_id, row_key, row_check, item_id, score (matched / item_words), matched (alignment score),
    item_words, start and end (code points of the stretch, end exclusive).
    """
    prepare(docs.sparkSession)
    identity, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    items = written(items_of(benchmark, item_id_col, item_text_col), "items")
    known = _sent(items.select(F.explode("grams").alias("gram")).distinct(), "grams")
    keyed = docs.select(*row_keys(identity, text), F.explode(document_grams(text)).alias("gram"))
    met = written(keyed.join(known, "gram").distinct(), "met")
    candidates = written(candidates_of(met, written(seeds_of(items, met), "seeds")), "candidates")
    holders = _sent(candidates.select("row_key", "row_check").distinct(), "holders")
    item = F.struct("item", "words")
    own = candidates.join(items.select("item", "words"), "item").groupBy("row_key", "row_check")
    own = own.agg(F.sort_array(F.collect_list(item)).alias("items"))
    texts = docs.select(identity.alias("doc_id"), *row_keys(identity, text), text.alias("text"))
    some = texts.join(holders, ["row_key", "row_check"], "left_semi").join(own, ["row_key", "row_check"])
    found = _search(some.select("doc_id", "row_key", "row_check", "text", "items"))
    named = found.join(items.select("item", "item_id"), "item").drop("item")
    return named.withColumn("score", F.col("matched") / F.col("item_words"))


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no benchmark item contaminates, with the columns they came with."""
    found = _sent(find(docs, benchmark, id_col, text_col).select("row_key", "row_check").distinct(), "contaminated")
    key, check = row_keys(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return docs.join(found, (key == found["row_key"]) & (check == found["row_check"]), "left_anti")
