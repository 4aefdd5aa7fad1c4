"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced inside shared keys.

A fingerprint has a bit for each bit of the shingles' hashes: set if more than half of them have
it. Candidates share a key: fingerprints that differ in at most `radius` bits agree on at least
`blocks - radius` of `blocks` blocks, so every choice of that many blocks is a key and no link is
missed.

Inside a key, candidates are stored vertically: one 64-bit word holds the same bit of 64
candidates. A query adds plane after plane to a few carry-save counters, 64 distances at a time,
and drops a word once all its candidates are too far. Large keys are cut into chunks of a bounded
size and every pair of chunks is compared by its own task, so no task holds an unbounded group.
A comparison returns the spanning stars of what it found, never all pairs; the components of
those links are the groups.

Exact copies share a fingerprint and are one candidate. Fingerprints that hold more than a share
`1 / HOT` of all rows, of which there are fewer than HOT, reach their rows by a broadcast; the
others by a shuffle.

Defined cases: a null or empty text has fingerprint zero and links like any other; a text
shorter than a shingle is one shingle; repeated rows are rows of their own; null ids are kept
and count as larger than all ids; an empty table gives an empty table; columns other than the
id and the text are ignored, or carried along by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import components, prepare, row_keys, written

SEED = 42
BITS = 64
CHUNK = 2048
HOT = 1000


@dataclass(frozen=True)
class Likeness:
    """How texts are fingerprinted, and how near their fingerprints must be."""

    shingle: int = 3  # words
    radius: int = 3  # differing bits
    blocks: int = 5  # more than the radius; more blocks make longer keys, and more of them


#: 64 bits of XXH64 over three words; all pairs within three bits.
CLOSE = Likeness()


def shingles(text: str | None, size: int) -> list[bytes]:
    """Every run of `size` words, repeats included; of fewer words the whole sequence."""
    words = (text or "").encode().lower().split()
    runs = [words] if 0 < len(words) < size else zip(*(words[i:] for i in range(size)), strict=False)
    return list(map(b" ".join, runs))


def fingerprints(texts, shingle: int = 3) -> np.ndarray:
    """The fingerprint of each text, as bytes: the bits set in more than half of its hashes."""
    found = [b"".join(xxhash.xxh64_digest(run, SEED) for run in shingles(t, shingle)) for t in texts]
    width = BITS // 8
    sizes = np.array([len(h) // width for h in found], np.int64)
    ones = np.zeros((len(found), width, 8), np.int64)
    if sizes.sum():
        octets = np.frombuffer(b"".join(found), np.uint8).reshape(-1, width)
        row = np.repeat(np.arange(len(found)) * 256, sizes)
        weight = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
        for i in range(width):  # counts of each byte value, then of each bit
            seen = np.bincount(row + octets[:, i], minlength=len(found) * 256)
            ones[:, i] = seen.reshape(-1, 256) @ weight
    set_ = (ones * 2 > sizes[:, None, None]).astype(np.uint8)
    return np.packbits(set_.reshape(len(found), BITS), axis=1)


def fingerprint_column(text: Column, like: Likeness) -> Column:
    @F.pandas_udf("binary")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in fingerprints(texts, like.shingle)])

    return compute(text)


# --- keys -----------------------------------------------------------------------------------


def key_masks(like: Likeness) -> np.ndarray:
    """Which bits each key looks at (keys x bits)."""
    block = np.arange(BITS) * like.blocks // BITS
    return np.array([np.isin(block, c) for c in combinations(range(like.blocks), like.blocks - like.radius)])


def keys_of(fp: Column, like: Likeness) -> Column:
    masks = np.packbits(key_masks(like), axis=1)

    @F.pandas_udf("array<long>")
    def compute(prints: pd.Series) -> pd.Series:
        def keys(p: bytes) -> list[int]:
            seen = masks & np.frombuffer(p, np.uint8)
            return [xxhash.xxh64_intdigest(row.tobytes()) >> 1 for row in seen]

        return prints.map(keys)

    return compute(fp)


# --- comparing ------------------------------------------------------------------------------


def near(prints: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """Which fingerprints lie within the radius of which others of their group.

    `prints` has a row of bytes each, `group` is sorted. Returns (row, first row of a word,
    bits): bit k says that row + k is near.
    """
    n = len(prints)
    rows = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, n])
    rank = rows - np.repeat(starts, size)
    word_starts = np.flatnonzero(rank % 64 == 0)
    group_words = (size + 63) // 64
    first_word = np.cumsum(group_words) - group_words
    slot = (rank % 64).astype(np.uint64)
    bits = np.unpackbits(prints, axis=1).T.astype(np.uint64)  # a row a plane
    valid = np.add.reduceat(np.uint64(1) << slot, word_starts)

    per_row = np.repeat(group_words, size)  # words that a row is compared with
    query = np.repeat(rows, per_row)
    word = np.arange(len(query)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    word += np.repeat(np.repeat(first_word, size), per_row)

    width = radius.bit_length()
    spare = (1 << width) - 1 - radius  # so that a counter overflows just beyond the radius
    full = ~np.uint64(0)
    counters = [np.full(len(query), full if spare >> i & 1 else 0, np.uint64) for i in range(width)]
    over = ~valid[word]
    for p, bit in enumerate(bits):
        plane = np.add.reduceat(bit << slot, word_starts)
        carry = plane[word] ^ (np.uint64(0) - bit[query])
        for i in range(width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if p % 8 == 7:  # abandon words whose candidates are all too far
            open_ = np.flatnonzero(over != full)
            if len(open_) < len(over):
                query, word, over = query[open_], word[open_], over[open_]
                counters = [c[open_] for c in counters]
    return list(zip(query.tolist(), word_starts[word].tolist(), (~over).tolist(), strict=True))


def stars(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(row, smallest row of its component) for rows that have another one nearby."""
    beside: dict[int, int] = {}
    for row, start, bits in found:
        beside[row] = beside.get(row, 0) | bits << start
    out, seen = [], set()
    for root in sorted(beside):
        if root in seen or beside[root] == 1 << root:
            continue
        reached = edge = 1 << root
        while edge:
            grown = 0
            for i in _positions(edge):
                grown |= beside[i]
            edge = grown & ~reached
            reached |= edge
        members = list(_positions(reached))
        seen.update(members)
        out += [(m, root) for m in members if m != root]
    return out


def _positions(mask: int) -> Iterator[int]:
    shift = (mask & -mask).bit_length() - 1
    mask >>= shift  # groups are runs of rows: the numbers stay as long as a group
    while mask:
        low = (mask & -mask).bit_length() - 1
        yield shift + low
        mask &= mask - 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints and group numbers of whole groups, out of batches sorted by group."""
    names, prints = np.zeros((0, 3), np.int64), None
    for batch in batches:
        ints = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        fresh = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        names = np.concatenate([names, np.stack(ints, axis=1)])
        prints = fresh if prints is None or not len(prints) else np.concatenate([prints, fresh])
        new = (names[1:] != names[:-1]).any(axis=1)
        if new.any():
            end = np.flatnonzero(new)[-1] + 1
            yield prints[:end], np.r_[0, np.cumsum(new[: end - 1])]
            names, prints = names[end:], prints[end:]
    if len(names):
        yield prints, np.zeros(len(names), np.int64)


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints, group in _runs(batches):
            cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(prints)]
            at = 0
            while at < len(prints):  # whole groups, a bounded number of rows at a time
                end = cuts[min(np.searchsorted(cuts, at + CHUNK), len(cuts) - 1)]
                part = prints[at:end]
                pairs = stars(near(part, group[at:end], radius))
                at = end
                if pairs:
                    sides = [pa.array([part[i].tobytes() for i in side]) for side in zip(*pairs, strict=True)]
                    yield pa.RecordBatch.from_arrays(sides, ["u", "v"])

    return link


def link(classes: DataFrame, like: Likeness) -> DataFrame:
    """Links (u, v) between the distinct fingerprints `fp`, enough to connect all near ones."""
    keyed = classes.select("fp", F.posexplode(keys_of(F.col("fp"), like)).alias("choice", "key"))
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    tile = F.xxhash64("choice", "key", F.least("part", "other"), F.greatest("part", "other"))
    dealt = (
        keyed.join(sizes, ["choice", "key"])
        .withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("long"))
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .select("choice", "key", "fp", "part", "parts", other)
        .select(tile.alias("tile"), "key", F.col("choice").cast("long").alias("choice"), "fp")
    )
    dealt = dealt.repartition("tile").sortWithinPartitions("tile", "key", "choice")
    return dealt.mapInArrow(_linker(like.radius), "u binary, v binary").distinct()


# --- groups ---------------------------------------------------------------------------------


def group(docs: DataFrame, like: Likeness = CLOSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, row_key, row_check, `fp` and `component_id`.

    `component_id` is the smallest id of the group, null if it has none.
    """
    prepare(docs.sparkSession)
    identity, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    prints = written(
        docs.select(identity.alias("doc_id"), *row_keys(identity, text), fingerprint_column(text, like).alias("fp")),
        "fingerprints",
    )
    counted = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = written(counted, "classes")
    members = _with_roots(components(link(classes.select("fp"), like)))
    lowest = members.join(classes, "fp").groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = members.join(lowest, "root").select("fp", "component_id")
    smallest = F.least("component_id", "rep").alias("component_id")
    whole = written(classes.join(linked, "fp", "left").select("fp", smallest, "n"), "groups")
    n_rows = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > n_rows // HOT + 1
    many = whole.filter(hot).drop("n")
    found = prints.join(F.broadcast(many), "fp")
    rest = prints.join(F.broadcast(many.select("fp")), "fp", "left_anti")
    return found.unionByName(rest.join(whole.filter(~hot).drop("n"), "fp"))


def _with_roots(found: DataFrame) -> DataFrame:
    return found.union(found.select("root", "root").distinct()).toDF("fp", "root")


def deduplicate(docs: DataFrame, like: Likeness = CLOSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-copies: of each group the row with the smallest id stays.

    Ties (repeated ids) are broken by the hash of the text; fully repeated rows become one.
    """
    grouped = group(docs, like, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "row_check")).alias("f")
    # A group that has null ids only has no smallest id: its fingerprint keeps it apart.
    lone = F.when(F.col("component_id").isNull(), F.col("fp")).alias("lone")
    kept = grouped.groupBy("component_id", lone).agg(first).select("f.row_key", "f.row_check")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keys = row_keys(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    keyed = docs.select(F.struct(*columns).alias("row"), *keys)
    return (
        keyed.join(kept, ["row_key", "row_check"], "left_semi")
        .groupBy("row_key", "row_check")
        .agg(F.first("row").alias("row"))
        .select("row.*")
    )
