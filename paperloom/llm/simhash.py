"""Operator 2: SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 2^(r+1)-1 bit masks keeps about half of the fingerprint. Bit i has a non-zero vector phi(i) of r+1
bits; mask v keeps the bits with odd <v, phi(i)>. Any r bits leave some v with even products, so for every pair
within radius r some mask ignores all the bits in which the two differ: no such pair is missed.

Only distinct fingerprints are compared, so a group of equal texts is one fingerprint. Buckets of up to SMALL
fingerprints are compared within; each sends a spanning forest, not its pairs. A larger bucket is dealt out
anew: its members differ in the ignored bits only, so two of them link exactly if they agree after clearing some
pair of these bits, and such a group has four members at most.

Results in special cases. Null, empty and blank texts: fingerprint zero, which links like any other. Fewer words than a shingle has: the whole
sequence is the shingle. Empty table: no rows. Very long texts: whole, their bits are counted in parts. Repeated rows: one fingerprint.
Rows with equal or null doc_ids are kept apart by shared.with_row_ids; component_id is the smallest non-null doc_id of the component, null if there is
none. Ties, a bit that is set in exactly half of the hashes: not set. Extra columns, also of names used here, are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, keeps_columns, let_go, small, stored, with_row_ids

SEED, BITS, SMALL = 42, 64, 512
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are counted at once.
AT_ONCE = 100_000


def covering_masks(radius: int) -> list[int]:
    """The masks as unsigned integers; the vectors run through all non-zero values, so the masks are balanced."""
    top = (1 << (radius + 1)) - 1
    phi = [i % top + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (v & phi[i]).bit_count() % 2) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, words: int) -> list[int]:
    w = text.translate(LOWER).split()
    if len(w) > words:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    else:
        shingles = [b" ".join(w)] if w else []
    return [xxhash.xxh64_intdigest(s, SEED) for s in shingles]


def _fingerprint_batches(words: int):
    def vote(hashes: list[list[int]]) -> list[int]:
        sizes = np.array([len(h) for h in hashes])
        out = np.zeros(len(hashes), np.uint64)
        if sizes.sum():
            flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            some = np.flatnonzero(sizes)
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1][some]
            counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            over = np.packbits(counts * 2 > sizes[some, None], axis=1, bitorder="little")
            out[some] = over.view(np.uint64)[:, 0]
        return out.view(np.int64).tolist()

    def long_vote(h: list[int]) -> int:
        total = np.zeros(BITS, np.int64)
        for a in range(0, len(h), AT_ONCE):
            part = np.array(h[a : a + AT_ONCE], np.uint64)
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.int64)[0])

    def run(batches):
        let_go()
        for batch in small(batches):
            out, held, size = [], [], 0
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                h = shingle_hashes(text or b"", words)
                if len(h) > AT_ONCE:
                    out += [*vote(held), long_vote(h)]
                    held, size = [], 0
                    continue
                held.append(h)
                size += len(h)
                if size >= AT_ONCE:
                    out += vote(held)
                    held, size = [], 0
            out += vote(held)
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), batch.column("doc_id"), pa.array(out, pa.int64())], ["_rid", "doc_id", "fp"])

    return run


def _bucket_links(radius: int):
    def run(batches):
        for batch in batches:
            a, b = [], []
            for fps in batch.column("fps").to_pylist():
                x = np.array(sorted(fps), np.int64)
                near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
                label = np.arange(len(x))
                while True:
                    low = np.where(near, label[None, :], len(x)).min(1)
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                far = label != np.arange(len(x))
                a.append(x[far])
                b.append(x[label[far]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(_rid, doc_id, fp) of docs that have a _rid."""
    narrow = docs.select("_rid", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprint_batches(words), "_rid bigint, doc_id bigint, fp bigint")


def links(fps: DataFrame, radius: int = 2, small: int = SMALL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span all links at `radius` or fewer differing bits."""
    masks = covering_masks(radius)
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(masks)))
    keyed = fps.select("fp", F.explode(table).alias("x")).select("fp", F.col("x.k").alias("k"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    counts = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(keyed.join(counts, ["k", "key"]), "simhash-buckets")
    buckets = members.where(F.col("n") <= small).groupBy("k", "key").agg(F.collect_list("fp").alias("fps"))
    near = buckets.select("fps").mapInArrow(_bucket_links(radius), "a bigint, b bigint")
    # of each mask the pairs of ignored bits, cleared; all masks in one pass, not a shuffle for each
    ignored = [[i for i in range(BITS) if not mask >> i & 1] for mask in masks]
    clear = F.array(*(F.array(*(F.lit(_signed(~sum(1 << i for i in c) & (1 << 64) - 1)) for c in combinations(bits, radius))) for bits in ignored))
    dealt = members.where(F.col("n") > small).select("k", "fp", F.posexplode(clear[F.col("k")]).alias("pair", "m"))
    groups = dealt.groupBy("k", "pair", F.col("fp").bitwiseAND(F.col("m")).alias("rest")).agg(F.collect_list("fp").alias("fps"))
    star = groups.where(F.size("fps") > 1).select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    near = near.union(star.where("a <> b"))
    return near


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(_rid, doc_id, fp, component_id, lead): lead is the smallest _rid of the component. docs must have _rid."""
    fp = stored(fingerprints(docs, words), "simhash")
    classes = fp.groupBy("fp").agg(F.min("_rid").alias("first"), F.min("doc_id").alias("least"))
    nodes = components(links(classes.select("fp"), radius))
    rooted = classes.join(nodes, classes.fp == nodes.node, "left").select("fp", "first", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("lead"), F.min("least").alias("component_id"))
    found = rooted.join(groups, "root").select("fp", "lead", "component_id")
    return fp.join(found, "fp").select("_rid", "doc_id", "fp", "component_id", "lead")


def simhash(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row."""
    found = near_duplicates(with_row_ids(docs), words, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@keeps_columns
def one_of_each(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs without those that are linked, over any steps, to a row before them."""
    numbered = with_row_ids(docs)
    found = near_duplicates(numbered, words, radius)
    return numbered.join(found.where("_rid = lead").select("_rid"), "_rid", "left_semi").select(*docs.columns)
