"""Ranked lexical search, reversed: documents stream through an index of the items.

Usually documents are indexed and queries look them up. Here the items (queries) are few and the
documents are not, so an inverted index over the items' terms, term to items that hold it, is
broadcast, and every document's term counts go through it once: each of its terms that the index
knows adds to the scores of the term's items. A task keeps a heap of the best documents of each
item, no more than wanted; the heaps are merged in two steps, a thousand tasks at a time and then
all, so no merge reads more than a bounded number of rows a task or group.

The statistics come from a pass before: documents and terms of the corpus, and documents holding
each indexed term, counted in the tasks and summed by a grouped aggregation. Scores are integers,
so they depend neither on the order of terms nor on that of tasks.

Items come in blocks of at most `BLOCK_POSTINGS` terms and `BLOCK_ITEMS` items (one longer item is
a block of its own), which bounds the index and the heaps; every block reads all documents.

Defined cases: a null or empty text has no terms, is not counted and never found; an item without
terms finds nothing; a repeated item is an item of its own; repeated documents are ranked each, and
equal scores by ascending id, null last; an empty table gives an empty table; columns other than
ids and texts are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwatch.llm.common import prepare, written

BEST = 20
BLOCK_POSTINGS, BLOCK_ITEMS = 1 << 20, 1 << 14
CELLS = 1 << 22  # scores (documents x items) that a task holds at a time
MERGED_TASKS = 1000

# Letters and digits of ASCII, and everything beyond ASCII; only A-Z change case.
_TABLE = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8. `bytes.split` cuts at nothing but ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


# --- the index ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """Terms are numbered; postings of term t are `first[t]` to `first[t + 1]`."""

    items: int
    number: dict[bytes, int]
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray  # the term stands in the item


def index_of(texts: list[str | None]) -> Index:
    held = [Counter(terms(t)) for t in texts]
    number = {term: i for i, term in enumerate(sorted(set().union(*held)))}
    rows = sorted((number[term], i, n) for i, counts in enumerate(held) for term, n in counts.items())
    table = np.array(rows, np.int64).reshape(-1, 3)
    return Index(len(texts), number, np.searchsorted(table[:, 0], np.arange(len(number) + 1)), table[:, 1], table[:, 2])


def term_weights(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    """1000 ln((2N + 2) / (2 df + 1)), rounded down."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)


def score(index: Index, weights: np.ndarray, counts: list[dict[int, int]], sizes: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    """Scores (documents x items) of documents given as counts of indexed terms and numbers of terms."""
    known = np.array([len(c) for c in counts], np.int64)
    doc = np.repeat(np.arange(len(counts)), known)
    term = np.fromiter((t for c in counts for t in c), np.int64, int(known.sum()))
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(term))
    m = np.array([75 + 25 * n * n_docs // n_terms for n in sizes], np.int64)
    value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
    reach = index.first[term + 1] - index.first[term]
    at = np.arange(reach.sum()) + np.repeat(index.first[term] - (np.cumsum(reach) - reach), reach)
    out = np.zeros(len(counts) * index.items, np.int64)
    np.add.at(out, np.repeat(doc, reach) * index.items + index.item[at], np.repeat(value, reach) * index.times[at])
    return out.reshape(len(counts), index.items)


class _Later:
    """Ids in descending order, null first: in a heap the worst of equal scores comes first."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        if self.value is None or other.value is None:
            return self.value is None and other.value is not None
        return other.value < self.value


class Heaps:
    """The `best` highest scores of each item, equal ones by ascending id."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.heaps: list[list[tuple[int, _Later]]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score below has no place any more

    def add(self, scores: np.ndarray, ids: list) -> None:
        for d, i in zip(*np.nonzero(scores >= self.least), strict=True):
            heap, entry = self.heaps[i], (int(scores[d, i]), _Later(ids[d]))
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.best:
                self.least[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, object, int]]:
        for i, heap in enumerate(self.heaps):
            for value, later in heap:
                yield i, later.value, value


# --- over tables ----------------------------------------------------------------------------


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items (id, text) in blocks of a bounded size, in the order of id and text."""
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    block, postings = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        size = len(set(terms(row.text)))
        if block and (postings + size > BLOCK_POSTINGS or len(block) == BLOCK_ITEMS):
            yield block
            block, postings = [], 0
        block.append((row.item_id, row.text))
        postings += size
    if block:
        yield block


def _counted(texts: DataFrame, index) -> DataFrame:
    """Rows (term, n): documents that hold each indexed term; -1: with any term; -2: all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Index(*index.value).number
        found = np.zeros(len(number), np.int64)
        n_docs = n_terms = 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                words = terms(text)
                n_docs += bool(words)
                n_terms += len(words)
                found[[number[w] for w in set(words) if w in number]] += 1
        held = np.flatnonzero(found)
        rows = [pa.array(np.r_[held, -1, -2], pa.int64()), pa.array(np.r_[found[held], n_docs, n_terms], pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, ["term", "n"])

    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _streamed(texts: DataFrame, index, weights: np.ndarray, n_docs: int, n_terms: int, best: int) -> DataFrame:
    """The heaps of every task: rows (task, item, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(*index.value)
        number, at_a_time = known.number, max(1, CELLS // known.items)
        heaps = Heaps(known.items, best)
        task, id_type = TaskContext.get().partitionId(), None
        ids, counts, sizes = [], [], []

        def flush() -> None:
            if ids:
                heaps.add(score(known, weights, counts, sizes, n_docs, n_terms), ids)
                ids.clear(), counts.clear(), sizes.clear()

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = terms(text)
                hits = Counter([number[w] for w in words if w in number])
                if hits:
                    ids.append(doc_id)
                    counts.append(hits)
                    sizes.append(len(words))
                    if len(ids) == at_a_time:
                        flush()
            flush()
        rows = list(heaps.rows())
        if rows:
            item, found, value = zip(*rows, strict=True)
            columns = [pa.array([task] * len(rows), pa.int32()), pa.array(item, pa.int32()), pa.array(found, id_type), pa.array(value, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["task", "item", "doc_id", "score"])

    id_type = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"task int, item int, doc_id {id_type}, score long")


def _merged(heaps: DataFrame, best: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The `best` documents of each item: item_id, rank from 1, doc_id, score."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kinds = dict(items.dtypes)
    schema = f"item int, item_id {kinds[item_id_col]}"
    parts = [spark.createDataFrame([], f"item_id {kinds[item_id_col]}, rank int, doc_id {dict(texts.dtypes)['doc_id']}, score long")]
    for block in blocks_of(items, item_id_col, item_text_col):
        known = index_of([text for _, text in block])
        # as a tuple: executors need no copy of this class to read it
        shared = spark.sparkContext.broadcast((known.items, known.number, known.first, known.item, known.times))
        counts = {r.term: r.n for r in _counted(texts, shared).collect()}  # a row a term of the block
        n_docs, n_terms = counts.pop(-1, 0), counts.pop(-2, 0)
        frequency = np.zeros(len(known.number), np.int64)
        frequency[list(counts)] = list(counts.values())
        heaps = _streamed(texts, shared, term_weights(frequency, n_docs), n_docs, n_terms, best)
        some = heaps.withColumn("some", F.expr(f"task div {MERGED_TASKS}"))
        merged = _merged(_merged(some, best, "item", "some").drop("rank"), best, "item")
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], schema)
        found = merged.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        parts.append(written(found, "search"))
    return reduce(DataFrame.unionAll, parts)
