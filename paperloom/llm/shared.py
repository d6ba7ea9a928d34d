"""Helpers that several corpus operators use: scratch tables, row identities, native spans, components."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the operators' contracts define it: what stands between these characters.
SPACE = r"[\x20\x09-\x0D]"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where all run in one process, a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("paperloom.scratch.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("paperloom.scratch.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


_made = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_made, "paths", None) is not None:
        _made.paths.append(path)
    return path


@contextmanager
def recorded_scratch() -> Iterator[list[str]]:
    """The paths of the scratch tables that this thread makes within."""
    before, _made.paths = getattr(_made, "paths", None), []
    try:
        yield _made.paths
    finally:
        _made.paths = before


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables. What was computed from them must be written before."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage for good."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Delete what `stored` wrote for these tables. Only for tables that no DataFrame still to be computed reads."""
    for t in tables:
        drop_scratch(t.sparkSession, [t._stored_at])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """In a worker: give back the memory that freed arrays have left with Arrow and the C library."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def let_go() -> None:
    """In a worker, which later tasks of other operators use again: drop the tokenizers that operators before this one have left there, and give their memory back."""
    bpe = sys.modules.get(f"{__package__}.bpe")
    left = [f for f in (bpe.rank_encoder, bpe.file_encoder, bpe.byte_strings) if f.cache_info().currsize] if bpe else []
    for f in left:
        f.cache_clear()
    if left:
        gc.collect()
        trim()


def small(batches, rows: int = 512):
    """Arrow batches in slices of a few rows, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole_text(name: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, also where body refers to it in a lambda."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space."""
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def running_sums(values: Column, wanted: Column, block: int = 256) -> Column:
    """For each 0-based index in `wanted`, the sum of the elements of `values` (ints) before it.

    Two levels of sums keep it near linear: whole blocks first, then the rest of one block.
    """
    plus = lambda a, b: a + b.cast("long")
    zero = F.lit(0).cast("long")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(values) / block).cast("int")),
        lambda b: F.aggregate(F.slice(values, b * block + 1, block), zero, plus),
    )
    before = lambda s: F.transform(
        F.sequence(F.lit(0), F.size(s) - 1), lambda b: F.aggregate(F.slice(s, F.lit(1), b), zero, plus)
    )
    return bind(
        blocks,
        lambda s: bind(
            before(s),
            lambda p: F.transform(
                wanted,
                lambda i: p[F.floor(i / block).cast("int")]
                + F.aggregate(F.slice(values, F.floor(i / block).cast("int") * block + 1, i % block), zero, plus),
            ),
        ),
    )


SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def match_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """The leftmost non-overlapping matches that `keep` accepts, as structs of code point start, end and text.

    The pieces between the matches and the matches themselves give the positions, so no Python is needed.
    """

    def located(pieces: Column, hits: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(hits) - 1)
        wanted = F.filter(every, lambda i: keep(hits[i])) if keep else every
        steps = F.zip_with(pieces, hits, lambda p, h: (F.length(p) + F.coalesce(F.length(h), F.lit(0))).cast("int"))
        return bind(
            wanted,
            lambda w: F.when(F.size(w) == 0, F.array().cast(SPAN)).otherwise(
                bind(
                    steps,
                    lambda s: F.zip_with(
                        w,
                        running_sums(s, w),
                        lambda i, at: F.struct(
                            (at + F.length(pieces[i])).cast("long").alias("start"),
                            (at + F.length(pieces[i]) + F.length(hits[i])).cast("long").alias("end"),
                            hits[i].alias("value"),
                        ),
                    ),
                )
            ),
        )

    return bind(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(
            bind(F.split(text, pattern, -1), lambda pieces: located(pieces, hits))
        ),
    )


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined, of structs (start, kind_no, kind, end) in their order."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def kind_spans(spans: Column, kind: str, kind_no: int) -> Column:
    """Spans as sortable structs of one kind."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(kind_no).alias("kind_no"),
            F.lit(kind).alias("kind"),
            s["end"].alias("end"),
            s["value"].alias("value"),
        ),
    )


def sifted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose long `key` is among ids (one column of the same name), and about one in 16 of the others: what an inner join that decides then shuffles.

    A bitmap of the ids' hashes, of 4 KB a part, sifts the rows where they stand. A semi join would be pushed below it, before the rows are sifted.
    """
    bits = min(max(15, (16 * ids.count()).bit_length()), 28)
    bit = lambda h: F.xxhash64(h).bitwiseAND(F.lit((1 << bits) - 1))
    marks = ids.select(bit(key).alias("bit"))
    parts = marks.groupBy(F.shiftright("bit", 15).alias("_part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("_map"))
    at = F.col("_bit").bitwiseAND(32767)
    byte = F.conv(F.hex(F.substr("_map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1
    placed = rows.withColumn("_bit", bit(key)).withColumn("_part", F.shiftright("_bit", 15))
    return placed.join(F.broadcast(parts), "_part").where(marked).select(*rows.columns)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a gapless number from 0 in the given order, from a range sort and one count for each partition.

    Only the counts of the partitions are summed in one place, never rows.
    """
    spark = df.sparkSession
    mark = F.monotonically_increasing_id()
    sorted_ = stored(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", mark), name)
    part = F.shiftright("_at", 33)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    base = counts.withColumn("_base", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    # one row for each partition of the sort, so its size is bounded by the partition count
    base = F.broadcast(base.select("_part", F.coalesce("_base", F.lit(0)).alias("_base")))
    return (
        sorted_.withColumn("_part", part)
        .join(base, "_part")
        .withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_base", "_at")
    )


def with_row_ids(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """docs with a unique long that sorts like doc_id.

    It is doc_id itself where that is unique and never null. Otherwise rows are numbered by doc_id (nulls
    last), then text: equal rows are in no particular order, which no result can tell apart.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    odd = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return numbered(docs, [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()], name)


def keeps_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators from documents to documents: columns named like the helpers' own (with a leading underscore) are
    set aside under other names meanwhile, and the result has the columns of its input in their order."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = docs.columns
        aside = {c: f"aside{n}{c}" for n, c in enumerate(names) if c.startswith("_")}
        back = {v: k for k, v in aside.items()}
        return operator(docs.withColumnsRenamed(aside), *args, **kwargs).withColumnsRenamed(back).select(*names)

    return run


def _stars(edges: DataFrame) -> bool:
    """Whether each node of (a, b), a > b, that has a smaller neighbour has no other neighbour: then b is the smallest node reachable from a."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = edges.select(F.inline(F.array(end("a", 1), end("b", 0))))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up = 1 and down > 0").limit(1).count()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of (a, b) edges of longs: (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps until only stars are left, in no more rounds than that takes. Each step is stored in the shared folder: its small files are
    read many at a time, so a step takes few tasks. The least neighbour of a node
    comes from a min aggregate, which combines before its shuffle; a hot node's edges then meet it in a join, where Spark splits skewed partitions.
    """
    edge = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while not _stars(edges):
        if not rounds:
            raise RuntimeError("components did not settle in the rounds given")
        rounds -= 1
        near = edges.select(F.inline(F.array(edge("a", "b"), edge("b", "a"))))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = stored(large.distinct(), "components")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.inline(F.array(edge("b", "m"), edge("a", "m"))))
        after = stored(small.where("a <> b").distinct(), "components")
        done_with(edges, down)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
