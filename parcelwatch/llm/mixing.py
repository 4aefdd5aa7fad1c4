"""Mixing sources to target weights: packed blocks, drawn counts, permuted indices, an index join.

The words of a source are one long sequence, cut into blocks of `BLOCK` words. Targets follow
from weights and from how often a word may be repeated. Each output shard draws its number of
slots per source from a multinomial; what all draws together miss of the targets is made up by
moving a few slots, so the shares of a shard are random and those of the whole are exact. A slot's number becomes a block number through a
pseudorandom permutation of the source (swap-or-not, new for every pass over the source), and
slots meet blocks in a join on (source, block). The last slot of a source may be a partial one.

Nothing but sums per source and counts per shard reaches the driver: more than `MAX_DRAWS` sources
are refused, and there are no more shards than keep the counts below that. Positions in a source come
from prefix sums in two levels, so a source with a third of all rows is not one task.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own,
ordered last; sources without words have target 0; repeated rows and null ids are documents of
their own; an empty table gives an empty mix; columns other than id, text, source are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import let, n_words, prepare, words_of, written

BLOCK = 128
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SHARD_SLOTS = 4096
MAX_SHARDS = 1024
MAX_DRAWS = 1_000_000  # rows (shard, source) of the drawn counts
BROADCAST_SOURCES = 10_000  # beyond that the table of sources is joined by a shuffle
SEED = 17
ROUNDS = 12
_STEP = 10_000  # slots made by one row
TASK_SLOTS = 50_000  # made by a task, about


@dataclass(frozen=True)
class Source:
    number: int
    name: str | None
    rows: int
    size: int
    target: float


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source: by weight, at most `most` times its size, the rest reshared."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        by_weight = {i: left * weights[i % len(weights)] / total for i in open_}
        above = [i for i in open_ if by_weight[i] > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = by_weight[i]
            break
        for i in above:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def draw_shards(quotas: list[int], n_shards: int, seed: int = SEED) -> np.ndarray:
    """Slots of each shard (row) and source: a multinomial draw each, then made to meet the quotas.

    The draws of all shards together miss a source's quota by about the root of it. Sources that got
    too much give back slots drawn evenly from theirs, in whatever shards they are, and sources that
    got too little take those slots in random order. So shards keep their sizes.
    """
    wanted = np.array(quotas, np.int64)
    total, rng = int(wanted.sum()), np.random.default_rng(seed)
    if not total:
        return np.zeros((n_shards, len(wanted)), np.int64)
    sizes = [total * (s + 1) // n_shards - total * s // n_shards for s in range(n_shards)]
    out = np.array([rng.multinomial(size, wanted / total) for size in sizes], np.int64)
    over = out.sum(axis=0) - wanted
    freed = np.zeros(n_shards, np.int64)
    for k in np.flatnonzero(over > 0):
        back = rng.multivariate_hypergeometric(out[:, k], over[k], method="marginals")
        out[:, k] -= back
        freed += back
    takers = rng.permutation(np.repeat(np.arange(len(wanted)), np.maximum(-over, 0)))
    np.add.at(out, (np.repeat(np.arange(n_shards), freed), takers), 1)
    return out


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, one for each key (swap-or-not)."""

    def swap(k: Column, r: Column) -> Column:
        # a quarter of the hash, so that the subtraction cannot overflow
        partner = F.pmod(F.shiftright(F.xxhash64(F.lit(SEED), r, *key), 2) - k, n)
        coin = F.xxhash64(F.lit(SEED + 1), r, F.greatest(k, partner), *key).bitwiseAND(F.lit(1)) == 1
        return F.when(coin, partner).otherwise(k)

    return F.aggregate(F.array(*(F.lit(r) for r in range(ROUNDS))), index.cast("long"), swap)


# --- the parts of a mix ---------------------------------------------------------------------


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def sources_of(sized: DataFrame, **how) -> list[Source]:
    """Sources by code point, null last, with their sums and targets."""
    sums = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    found = sums.limit(MAX_DRAWS + 1).collect()
    if len(found) > MAX_DRAWS:
        raise ValueError(f"more than {MAX_DRAWS} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r["size"] for r in found], **how)
    return [Source(i, r.source, r.rows, r["size"], t) for i, (r, t) in enumerate(zip(found, wanted, strict=True))]


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        n_words(text).alias("size"),
        F.xxhash64(text).alias("tie"),
        *more,
    )


def placed(sized: DataFrame, sources: list[Source], *row: str) -> DataFrame:
    """Each document's first word in the sequence of its source: column `at`, beside `number`.

    `row` names a column that tells equal documents apart, if there is one.
    """
    spark = sized.sparkSession
    rows = [
        (s.number, s.name, s.size, s.target, max(1, -(-s.rows // max(1000, -(-s.rows // 100_000)))))
        for s in sources
    ]
    schema = "number int, name string, source_size long, target double, buckets int"
    known = _bounded(spark.createDataFrame(rows, schema), len(rows))
    bucket = F.pmod(F.xxhash64("doc_id", "tie"), F.col("buckets"))
    dealt = sized.join(known, sized["source"].eqNullSafe(known["name"])).withColumn("bucket", bucket)
    keys = ("number", "bucket")
    sums = dealt.groupBy(*keys).agg(F.sum("size").alias("words"))
    before = F.expr("coalesce(sum(words) over (partition by number order by bucket rows between unbounded preceding and 1 preceding), 0)")
    starts = sums.select(*keys, before.alias("bucket_at"))
    order = ", ".join(("doc_id", "tie", "size", *row))
    inside = F.expr(
        f"coalesce(sum(size) over (partition by number, bucket order by {order}"
        " rows between unbounded preceding and 1 preceding), 0)"
    )
    columns = ("doc_id", "source", "size", "tie", "number", "source_size", "target", *row)
    ordered = dealt.select(*columns, "bucket", inside.alias("inside"))
    return ordered.join(starts, list(keys)).select(*columns, (F.col("bucket_at") + F.col("inside")).alias("at"))


def slots_of(spark, sources: list[Source], block: int = BLOCK) -> DataFrame:
    """The slots of the mix: shard, number (source), slot, epoch, block, take (words), place.

    `place` orders the slots of a shard; `take` words are used from the start of the block.
    """
    plan, quotas = [], []
    for s in sources:
        words = round(s.target)
        full, tail = divmod(s.size, block)
        n = full + (tail > 0)
        epochs, rest = divmod(words, s.size) if s.size else (0, 0)
        q, partial = (rest // block, rest % block) if rest <= full * block else (full, rest - full * block)
        plan.append((s.number, n, full, tail, epochs, q, partial, rest > full * block))
        quotas.append(epochs * n + q + (partial > 0))
    schema = "number int, n long, full long, tail long, epochs long, q long, partial long, into_tail boolean"
    plans = _bounded(spark.createDataFrame(plan, schema), len(plan))
    total = sum(quotas)
    shards = max(1, min(MAX_SHARDS, MAX_DRAWS // max(1, len(quotas)), -(-total // SHARD_SLOTS)))
    drawn = draw_shards(quotas, shards)
    first = np.cumsum(drawn, axis=0) - drawn
    rows = [
        (s, k, int(first[s, k]), int(drawn[s, k]))
        for s in range(shards)
        for k in range(len(quotas))
        if drawn[s, k]
    ]
    draws = spark.createDataFrame(rows, "shard int, number int, first long, slots long")
    last = F.col("first") + F.col("slots") - 1
    pieces = draws.select("shard", "number", last.alias("last"), F.explode(F.sequence("first", last, F.lit(_STEP).cast("long"))).alias("from"))
    # A number of partitions that follows the slots: few rows are dealt, but many come out of them.
    pieces = pieces.repartition(-(-total // TASK_SLOTS) or 1, "shard", "number", "from")
    upto = F.least("last", F.col("from") + _STEP - 1)
    slots = pieces.select("shard", "number", F.explode(F.sequence("from", upto)).alias("slot"))
    epoch, j = F.expr("slot div n"), F.col("slot") % F.col("n")
    whole, last_full = F.col("epoch") < F.col("epochs"), F.col("j") < F.col("q")
    in_tail = ~whole & ~last_full & F.col("into_tail")
    span = F.when(whole, F.col("n")).otherwise(F.col("full"))
    index = F.when(in_tail, F.col("full")).otherwise(
        permuted(F.col("j"), F.greatest(span, F.lit(1).cast("long")), F.col("number"), F.col("epoch"))
    )
    length = F.when(F.col("block") < F.col("full"), F.lit(block).cast("long")).otherwise(F.col("tail"))
    return (
        slots.join(plans, "number")
        .withColumns({"epoch": epoch, "j": j})
        .withColumn("block", index)
        .select(
            "shard",
            "number",
            "slot",
            "epoch",
            "block",
            F.when(whole | last_full, length).otherwise(F.col("partial")).alias("take"),
            F.xxhash64(F.lit(SEED), "number", "slot").alias("place"),
        )
    )


def _blocks_of(at: Column, size: Column, block: int) -> Column:
    first, last = F.floor(at / block), F.floor((at + size - 1) / block)
    return F.sequence(first.cast("long"), last.cast("long"))


def taken(placed_: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """`placed` documents with `taken`: how many of their words the mix takes, repeats counted."""
    keep = ("doc_id", "size", "source_size", "target", "number", "at")
    some = placed_.filter("size > 0")
    pieces = some.select(*keep, F.explode(_blocks_of(F.col("at"), F.col("size"), block)).alias("block"))
    start = F.col("block") * block
    low = F.greatest(F.col("at") - start, F.lit(0).cast("long"))
    high = F.least(F.col("at") + F.col("size") - start, F.lit(block).cast("long"))
    uses = slots.groupBy("number", "block").agg(F.sort_array(F.collect_list("take")).alias("takes"))
    used = F.aggregate(
        F.coalesce("takes", F.array().cast("array<long>")),
        F.lit(0).cast("long"),
        lambda acc, take: acc + F.greatest(F.least(high, take) - low, F.lit(0).cast("long")),
    )
    met = pieces.join(uses, ["number", "block"], "left").withColumn("used", used)
    summed = met.groupBy("number", "at").agg(
        *(F.first(c).alias(c) for c in keep[:4]), F.sum("used").alias("taken")
    )
    out = (*keep[:4], "taken")
    return summed.select(*out).union(
        placed_.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out)
    )


def account(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken."""
    prepare(docs.sparkSession)
    sized = written(sized_documents(docs, id_col, text_col, source_col), "sizes")
    sources = sources_of(sized, **how)
    return taken(placed(sized, sources), slots_of(docs.sparkSession, sources))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed blocks: shard, place, source, slot, epoch, block, n_words, doc_ids, text.

    Sorted by (shard, place) they are the training stream. Words are joined by single spaces.
    """
    spark = prepare(docs.sparkSession)
    # The texts are written with a number a row, by which they meet their places: equal documents
    # stay apart, and a task that runs again sees the same numbers.
    row, text = F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text")
    numbered = sized_documents(docs, id_col, text_col, source_col, row, text)
    numbered = written(numbered, "texts")
    sources = sources_of(numbered, **how)
    where = placed(numbered.drop("text"), sources, "row").filter("size > 0")
    both = numbered.filter("size > 0").select("row", "text").join(where, "row")

    def cut(words: Column) -> Column:
        def piece(block: Column) -> Column:
            low = F.greatest(block * BLOCK - F.col("at"), F.lit(0).cast("long"))
            high = F.least((block + 1) * BLOCK - F.col("at"), F.col("size"))
            part = F.slice(words, (low + 1).cast("int"), (high - low).cast("int"))
            return F.struct(block.alias("block"), F.concat_ws(" ", part).alias("text"))

        return F.transform(_blocks_of(F.col("at"), F.col("size"), BLOCK), piece)

    pieces = both.select("number", "at", "doc_id", F.explode(let(words_of(F.col("text")), cut)).alias("part"))
    piece = F.struct("at", "doc_id", F.col("part.text").alias("text"))
    packed = pieces.select("number", F.col("part.block").alias("block"), piece.alias("piece")).groupBy("number", "block")
    blocks = packed.agg(F.sort_array(F.collect_list("piece")).alias("pieces"))  # at most BLOCK pieces
    names = spark.createDataFrame([(s.number, s.name) for s in sources], "number int, source string")
    whole = F.split(F.concat_ws(" ", "pieces.text"), " ")
    words = F.slice(whole, F.lit(1), F.col("take").cast("int"))
    return (
        slots_of(spark, sources)
        .join(blocks, ["number", "block"])
        .join(_bounded(names, len(sources)), "number")
        .select(
            "shard", "place", "source", "slot", "epoch", "block",
            F.col("take").alias("n_words"),
            F.col("pieces.doc_id").alias("doc_ids"),
            F.concat_ws(" ", words).alias("text"),
        )
    )
