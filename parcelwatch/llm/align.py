"""Alignment of two tokenizers: token groups between shared cuts, by divide and conquer.

Two tokenizers cut the bytes of a text at different places. An offset where both end a token is a
shared cut. An interval of tokens is divided at a shared cut near its middle: the ends of one
tokenizer around the middle are looked up among those of the other by bisection, in a window that
doubles until it meets a shared cut or has covered the interval. Both halves are divided again; an
interval without an inner cut is a leaf, the smallest group of tokens that spell the same bytes.
All intervals of a slice of texts are divided at the same time, a level a step, so the steps are
array operations and follow the depth of the division, not the number of groups.

Inside a group two tokens are linked if their byte ranges overlap. How many documents of the corpus
hold a pair of ids linked is counted in two steps, in a chunk of documents and over all chunks, and
comes back to the documents by chunk: what is shuffled is a row per chunk and pair, so a pair that
every document holds is a row a chunk, and no task holds more than a chunk.

The vocabularies are files of public tokenizers. `folder` names the place where every executor
finds them; nothing of them is stored here.

Defined cases: a null or empty text has no tokens, nor has a text that either tokenizer does not
give back byte by byte (it replaces or drops characters); such documents have empty arrays, zeros
and an empty digest, and count for no pair. Strings of special tokens inside a text are plain text.
Repeated rows and null ids are documents of their own; an empty table gives an empty table; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import prepare, slices, written

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_BYTES = 4 << 20  # of text that is divided at a time; a longer text is a slice of its own
ID_BITS = 20

# How byte-level vocabularies cut a text before merging.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Tokenizer:
    encode: Callable[[list[str]], list[list[int]]]
    spelt: list[bytes]  # of each id


def byte_level(path: str) -> Tokenizer:
    """Byte-level pairs, out of a JSON file whose merges are in the order of their ids.

    Merging by rank is left to the faster of the two libraries that read such vocabularies; it
    gives the same ids (tests/llm/test_align.py compares them).
    """
    import tiktoken

    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in byte.values())}
    ranks = {bytes(map(byte.__getitem__, entry)): i for entry, i in model["vocab"].items()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(model["vocab"]["".join(m)] != 256 + i for i, m in enumerate(merges)) or len(ranks) != 256 + len(merges):
        raise ValueError(f"{path}: ids do not follow the merges")
    core = tiktoken.Encoding("byte-level", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer(lambda texts: [core.encode_ordinary(t) for t in texts], sorted(ranks, key=ranks.get))


def pieces(path: str) -> Tokenizer:
    """Pieces with byte fallback, out of a model file. It puts a space before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def bytes_of(piece: str) -> bytes:
        single = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes.fromhex(single[1]) if single else piece.replace("▁", " ").encode()

    spelt = [bytes_of(model.id_to_piece(i)) for i in range(model.get_piece_size())]
    return Tokenizer(lambda texts: model.encode(texts, num_threads=1), spelt)


# --- dividing -------------------------------------------------------------------------------


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _nearest_cut(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each interval the index in `a` of a shared cut near its middle, -1 if there is none.

    The indices low..high - 1 are the inner ends of the interval. All of them are below the last
    end of `a`, so a place found in `b` exists.
    """
    middle = (low + high) // 2
    found = np.full(len(low), -1)
    open_ = np.flatnonzero(low < high)
    width = 1
    while len(open_):
        first = np.maximum(low[open_], middle[open_] - width + 1)
        size = np.minimum(high[open_], middle[open_] + width) - first
        index = _ranges(first, size)
        owner = np.repeat(open_, size)
        hit = b[np.searchsorted(b, a[index])] == a[index]
        index, owner = index[hit], owner[hit]
        order = np.lexsort((np.abs(index - middle[owner]), owner))
        owners, nearest = np.unique(owner[order], return_index=True)
        found[owners] = index[order][nearest]
        whole = (middle[open_] - width + 1 <= low[open_]) & (middle[open_] + width >= high[open_])
        open_ = open_[(found[open_] < 0) & ~whole]
        width *= 2
    return found


def divide(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The leaves: indices in `a`, ascending, of the last tokens of all groups.

    `a` and `b` are ascending ends; `starts` has the index in `a` of the first token of each text.
    The last ends of a text are the same in both, so texts are the first intervals.
    """
    low, high = starts, np.r_[starts[1:], len(a)]
    leaves = []
    while len(low):
        cut = _nearest_cut(a, b, low, high - 1)
        leaves.append(high[cut < 0] - 1)
        inner = cut >= 0
        low, high, cut = low[inner], high[inner], cut[inner] + 1
        low, high = np.r_[low, cut], np.r_[cut, high]
    return np.sort(np.concatenate([np.zeros(0, np.int64), *leaves]))


@dataclass(frozen=True)
class Aligned:
    """Texts laid out one after the other; `*_cuts` are token counts up to the end of each group."""

    ids: tuple[np.ndarray, np.ndarray]
    tokens: tuple[np.ndarray, np.ndarray]  # of each text
    cuts: tuple[np.ndarray, np.ndarray]
    groups: np.ndarray  # of each text


def align(texts: list[str | None], one: Tokenizer, other: Tokenizer) -> Aligned:
    """`one` encodes space and text, `other` the text, as it puts the space there itself."""
    given = [t or "" for t in texts]
    rows = [one.encode([" " + t for t in given]), other.encode(given)]
    for i, text in enumerate(given):
        want = b" " + text.encode("utf-8", "surrogatepass")
        if not text or any(b"".join(map(t.spelt.__getitem__, r[i])) != want for t, r in zip((one, other), rows, strict=True)):
            rows[0][i] = rows[1][i] = []
    tokens = [np.array([len(r) for r in side], np.int64) for side in rows]
    ids = [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(rows, tokens, strict=True)]
    ends = [np.cumsum(np.array([len(s) for s in t.spelt], np.int64)[i]) for t, i in zip((one, other), ids, strict=True)]
    whole = tokens[0] > 0
    last = divide(*ends, (np.cumsum(tokens[0]) - tokens[0])[whole])
    first_token = [np.cumsum(n) - n for n in tokens]
    text = np.searchsorted(np.cumsum(tokens[0]), last, "right")
    beside = np.searchsorted(ends[1], ends[0][last])
    cuts = (last + 1 - first_token[0][text], beside + 1 - first_token[1][text])
    return Aligned(tuple(ids), tuple(tokens), cuts, np.bincount(text, minlength=len(given)))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, pa.int32()))


def align_documents(docs: DataFrame, folder: str = FOLDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, the ids of both tokenizers, and the tokens up to each cut.

    Group g of a document is `a_ids[a_cuts[g - 1]:a_cuts[g]]` beside `b_ids[b_cuts[g - 1]:b_cuts[g]]`.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = other = None
        for batch in batches:
            if one is None:
                one, other = byte_level(f"{folder}/{BYTE_LEVEL}"), pieces(f"{folder}/{PIECES}")
            rows = batch.column(1).to_pylist()
            for part in slices([len(t or "") for t in rows], SLICE_BYTES):
                found = align(rows[part], one, other)
                columns = [_lists(i, n) for i, n in zip(found.ids, found.tokens, strict=True)]
                columns += [_lists(c, found.groups) for c in found.cuts]
                ids = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    id_type = dict(texts.dtypes)["doc_id"]
    lists = ", ".join(f"{name} array<int>" for name in ("a_ids", "b_ids", "a_cuts", "b_cuts"))
    return texts.mapInArrow(run, f"doc_id {id_type}, {lists}")


# --- links ----------------------------------------------------------------------------------


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of every overlapping pair, given where the tokens end.

    A new pair begins wherever either tokenizer begins a token, so pairs are the stretches between
    neighbouring ends. Ends are marked byte by byte; the marks before an end number its tokens.
    """
    size = int(a_ends[-1]) + 1 if len(a_ends) else 0
    marks = np.zeros((2, size), np.int8)
    for mark, ends in zip(marks, (a_ends, b_ends), strict=True):
        mark[ends] = 1
    ends = np.flatnonzero(marks[0] | marks[1])
    return tuple(np.cumsum(mark, dtype=np.int64)[ends] - mark[ends] for mark in marks)


def groups_text(ids: tuple[np.ndarray, np.ndarray], cuts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;`: the ids of each group as ASCII, and where each token's part ends.

    `cuts` are the numbers of tokens up to the end of each group. Tokens come in the order of the
    text: those of one tokenizer in a group, then those of the other.
    """
    before = [np.r_[0, c[:-1]] if len(c) else c for c in cuts]
    sizes = [c - b for c, b in zip(cuts, before, strict=True)]
    n = len(ids[0]) + len(ids[1])
    said, sign = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
    for i, aside, end in ((0, before[1], "|"), (1, cuts[0], ";")):
        place = np.arange(len(ids[i])) + np.repeat(aside, sizes[i])
        said[place] = ids[i]
        sign[place[cuts[i] - 1]] = ord(end)
    digits = np.ones(n, np.int64)
    for power in range(1, 7):
        digits += said >= 10**power
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    out[ends - 1] = sign
    for k in range(int(digits.max(initial=0))):  # the last digit, the one before it ...
        there = digits > k
        out[ends[there] - 2 - k] = said[there] % 10 + ord("0")
        said //= 10
    return out, ends


def _described(batch: pa.RecordBatch, lengths: tuple[np.ndarray, np.ndarray], chunk: int) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk, and then a row with the chunk's pairs of ids."""
    sides = [batch.column(i) for i in range(1, 5)]
    offsets = [c.offsets.to_numpy().astype(np.int64) for c in sides]
    values = [c.values.to_numpy()[o[0] : o[-1]].astype(np.int64) for c, o in zip(sides, offsets, strict=True)]
    offsets = [o - o[0] for o in offsets]
    ids, sizes = values[:2], [np.diff(o) for o in offsets]
    a, b = links(*(np.cumsum(n[i]) for n, i in zip(lengths, ids, strict=True)))
    doc = np.searchsorted(offsets[0][1:], a, "right")
    n_links = np.bincount(doc, minlength=batch.num_rows)
    key = doc << 2 * ID_BITS | ids[0][a] << ID_BITS | ids[1][b]
    key, times = np.unique(key, return_counts=True)
    doc, pair = key >> 2 * ID_BITS, key & (1 << 2 * ID_BITS) - 1
    pairs, place, holders = np.unique(pair, return_inverse=True, return_counts=True)
    cuts = [c + np.repeat(o[:-1], sizes[2]) for c, o in zip(values[2:], offsets[:2], strict=True)]
    said, ends = groups_text(ids, cuts)
    at = np.r_[0, ends][offsets[0] + offsets[1]]
    digests = [sha256(said[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]
    per_doc = np.bincount(doc, minlength=batch.num_rows)
    n_a, n_b, n_groups = sizes[:3]
    n = batch.num_rows
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, chunk), pa.int64()),
            batch.column(0),
            *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)),
            pa.array(digests),
            _lists(place, per_doc),
            _lists(times, per_doc),
            pa.nulls(n, pa.list_(pa.int64())),
            pa.nulls(n, pa.list_(pa.int32())),
        ],
        _DESCRIBED,
    )
    if len(pairs):
        whole = [pa.array([chunk], pa.int64()), pa.nulls(1, batch.schema.field(0).type), *[pa.nulls(1, pa.int64())] * 4]
        whole += [pa.nulls(1, pa.string()), *[pa.nulls(1, pa.list_(pa.int32()))] * 2]
        whole += [pa.array([pairs], pa.list_(pa.int64())), pa.array([holders], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(whole, _DESCRIBED)


_DESCRIBED = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "place", "times", "pairs", "holders"]


def describe(aligned: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Rows of documents with their counts, digest and linked pairs, and a row per chunk.

    A document names its pairs by their place in the list `pairs` of its chunk; `holders` says how
    many documents of the chunk hold each. A chunk is a batch of rows, numbered by task and order.
    """

    both = byte_level(f"{folder}/{BYTE_LEVEL}"), pieces(f"{folder}/{PIECES}")
    lengths = tuple(np.array([len(s) for s in t.spelt], np.int64) for t in both)
    if max(map(len, lengths)) > 1 << ID_BITS:
        raise ValueError(f"vocabularies of more than {1 << ID_BITS} ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                yield from _described(batch, lengths, chunk)
                chunk += 1

    id_type = dict(aligned.dtypes)["doc_id"]
    schema = (
        f"chunk long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "place array<int>, times array<int>, pairs array<long>, holders array<int>"
    )
    return aligned.mapInArrow(run, schema)


def pair_counts(described: DataFrame) -> DataFrame:
    """a_id, b_id, `n_docs` that hold the pair linked, and whether no other b_id has more with this a_id."""
    held = described.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
    pair = held.select(F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    counts = pair.groupBy("pair").agg(F.sum("n").alias("n_docs"))
    ids = counts.select(F.shiftright("pair", ID_BITS).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).cast("int").alias("b_id"), "pair", "n_docs")
    highest = ids.groupBy("a_id").agg(F.max("n_docs").alias("highest"))
    return ids.join(highest, "a_id").select("a_id", "b_id", "pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


def link_report(docs: DataFrame, folder: str = FOLDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its numbers of tokens, groups and links, and what its links count corpus-wide.

    `n_best`: links whose pair has the highest count of its a_id; `count_sum`: of all links.
    """
    described = written(describe(align_documents(docs, folder, id_col, text_col), folder), "alignment")
    counts = pair_counts(described)
    held = described.filter("pairs is not null").select("chunk", F.posexplode("pairs").alias("place", "pair"))
    known = held.join(counts.select("pair", "n_docs", "best"), "pair").select("chunk", "place", "n_docs", "best")
    known = known.toDF("of_chunk", "at", "n_docs", "best")
    rows = described.filter("pairs is null").drop("pairs", "holders")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = right.column("at").to_numpy()
        count[at] = right.column("n_docs").to_numpy()
        best[at] = right.column("best").to_numpy()
        place = left.column("place").combine_chunks()
        times = left.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(left.num_rows), np.diff(place.offsets.to_numpy()))
        place = place.flatten().to_numpy()
        out = []
        for value in (best, count):
            total = np.zeros(left.num_rows, np.int64)
            np.add.at(total, doc, value[place] * times)
            out.append(pa.array(total))
        named = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return named.append_column("n_best", out[0]).append_column("count_sum", out[1])

    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(sums, schema)
