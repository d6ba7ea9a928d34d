"""Operator 12: token ids in ORC files, ordered by document.

Texts are dealt out by ranges of doc_id and sorted, then encoded where they lie, so the order of files and of rows in them is that of
the documents, and only texts are shuffled. A row holds doc_id, part (the number of its file), local_start (ids of the file before it), n_tokens and
ids. ORC writes the integers run-length encoded, in stripes that are read in parallel, with row indexes and Bloom filters on doc_id: a reader that asks
for some documents skips files and stripes by their ranges and row groups by range and filter. Beside the files lies a table of one row
for each, with the ids before it, its documents and its range; `start` is base + local_start, so nothing is rewritten and no running sum passes over all rows.

Results in special cases. Null or empty text: the end token alone. Empty table: no rows, the files hold none. Very long texts: whole. Special tokens that a text
spells out are single tokens, as the library has them. Null doc_ids come last. Repeated rows, equal or null doc_ids: each row by itself, ordered by a
hash of the text, then the text, which also spreads an id that many rows share. Other columns, also of names used here, are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _LETTER, _PLAIN, PieceEncoder, _one_thread
from .shared import partitions, scratch_path, small

ROWS = "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>"
PARTS = "part int, base bigint, n_docs bigint, n_ids bigint, first_id bigint, last_id bigint"
#: How the tokenizer file that this reads quickly normalises and splits. Files with other settings go through the library alone.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern for lower-cased texts of the plain characters.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")


class WordEncoder(PieceEncoder):
    """Splits lower-cased texts of plain characters by itself; NFC changes none of them, and white space is dropped."""

    def split(self, text: str) -> list[str] | None:
        if self.quick and _PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
            return _PIECES.findall(text.lower())
        return None


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The ids that the tokenizer file gives without adding special tokens."""
    _one_thread()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    state = json.loads(tokenizer.to_str())
    steps = (state["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}]
    split = {k: steps[0].get(k) for k in ("type", "pattern", "behavior", "invert")} == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    mapped = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    plain = not state["truncation"] and not state["padding"] and not state["post_processor"] and state["model"]["type"] == "BPE" and not state["model"].get("dropout")
    return WordEncoder(tokenizer, None, plain and split and mapped and state["normalizer"] == NORMAL, tuple(a["content"] for a in state["added_tokens"]))


def _encoded(path: str, end: int):
    def run(batches):
        from pyspark import TaskContext

        encoder, tail, part, before = word_encoder(path), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in small(batches):
            ids = [encoder.ids(t or "") + tail for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
            rows = [batch.column("doc_id"), pa.array(np.full(len(ids), part), pa.int32()), pa.array(before + ends - sizes), pa.array(sizes), lists]
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "part", "local_start", "n_tokens", "ids"])

    return run


def write(docs: DataFrame, path: str, folder: str, end: int = 2, stripe_mb: int = 64, index_rows: int = 10_000) -> None:
    """Write the ids of docs (doc_id, text) to a new folder, as many files as spark.sql.shuffle.partitions."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = narrow.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text")
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(index_rows),
        "orc.stripe.size": str(stripe_mb << 20), "compression": "zstd",
    }
    dealt.mapInArrow(_encoded(path, end), ROWS).write.options(**options).orc(f"{folder}/ids")
    files = _rows(spark, folder).groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # a row for each file, so this window is small
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files.select("part", F.coalesce(before, F.lit(0)).cast("bigint").alias("base"), "n_docs", "n_ids", "first_id", "last_id").write.orc(f"{folder}/parts")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ROWS).orc(f"{folder}/ids")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of each file without reading it."""
    return spark.read.schema(PARTS).orc(f"{folder}/parts")


def read(spark: SparkSession, folder: str, wanted: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents in a folder. wanted: a condition on doc_id, part or n_tokens, which reaches the files' indexes."""
    rows = _rows(spark, folder)
    if wanted is not None:
        rows = rows.where(wanted)
    return rows.join(parts(spark, folder).select("part", "base"), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """The rows of some documents: Bloom filters and ranges leave out what holds none of them."""
    return read(spark, folder, F.col("doc_id").isin([int(i) for i in ids]))


def checked(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows with ids."""

    def run(batches):
        for batch in small(batches):
            lists = batch.column("ids")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4"), lists.offsets.to_numpy()
            at = at - at[0]
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def written(docs: DataFrame, path: str) -> str:
    """The folder in the shared scratch place to which docs were written."""
    folder = scratch_path(docs.sparkSession, "token-ids")
    write(docs, path, folder)
    return folder
