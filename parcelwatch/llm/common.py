"""What the corpus operators share: tables, written intermediates, words, graph components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwatch.session import configure, shared_dir
from parcelwatch.sources import storage

# A word is a run of anything but ASCII white space. `bytes.split()` splits at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

# Rows per Arrow batch. Documents are long, so batches are kept short to bound a worker's memory.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of `df`, read back from a table in the shared folder.

    Cuts the lineage: what is used more than once is computed once, and a lost executor
    costs a read of the table instead of the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The tables written inside each `settled` that is under way.
_open: list[list[str]] = []


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The rows of `make()`, written; the tables that were written to make them are deleted.

    Also when it fails: what a job leaves behind then are the results of earlier ones alone.
    """
    made: list[str] = []
    _open.append(made)
    try:
        df = written(make(), label)
        made.pop()  # the result stays
    finally:
        _open.remove(made)
        for path in made:
            storage.delete(spark, path)
    return df


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(key: Column, n: int) -> Column:
    """CRC-32 of the key as text, modulo n; null keys fall in fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(0))


def row_keys(identity: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes that tell the rows of a table apart by id and text."""
    return F.xxhash64(identity, text).alias("row_key"), F.hash(text, identity).alias("row_check")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one if the frame already has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of a graph: (u, v) edges to (node, root), root the smallest node.

    Alternates large-star and small-star steps: every node is linked to the smallest node it
    sees until all links are stars. Each round is a few grouped minima and joins on the node,
    so a hub is combined before the shuffle and split by the skew handling of the join.
    Roots themselves are not listed. Null ends and loops are ignored.
    """
    u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    proper = F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    links = written(edges.filter(proper).select(u, v).distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = links.union(links.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(lowest, "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(
            F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))
        ).alias("p")
        small = (
            large.join(lowest, "u")
            .select(pairs)
            .select(F.col("p.u").alias("u"), F.col("p.m").alias("v"))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        links = written(small, "links")


def slices(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Runs of neighbours with a sum of at most `most`; one that is larger is a run of its own."""
    at = total = 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield slice(at, i)
            at, total = i, 0
        total += size
    if len(sizes) > at:
        yield slice(at, len(sizes))


def bounded_sample(labelled: DataFrame, label: str, per_class: int, key: Column) -> DataFrame:
    """About `per_class` rows of each label at most, chosen by a hash of `key`, one a key.

    The share of each label follows from its number of keys, so the rows are the same on every
    run and neither the table nor a key that many rows repeat makes them more.
    """
    name = free_name(labelled, "sample_key")
    keyed = labelled.withColumn(name, key)
    counts = keyed.groupBy(label).agg(F.approx_count_distinct(name, 0.02)).collect()
    draw = F.pmod(F.xxhash64(name, F.lit("sample")), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in counts:
        share = int((1 << 30) * min(1.0, per_class / max(n, 1)))
        keep = keep | ((F.col(label) == F.lit(value)) & (draw < share))
    return keyed.filter(keep).dropDuplicates([label, name]).drop(name)
