"""Operator 13: importance resampling towards a target distribution, over hashed runs of words.

A document's features are its runs of one to three words; a feature counts in a bucket by its CRC-32. A bucket's gain is the logarithm of how much more often the
target has it, with one added everywhere, in thousandths. A document's weight is the sum of the gains of its features, its score that plus Gumbel noise that
depends on its id alone, so that the highest scores are a draw without replacement by weight.

Long texts are cut into chunks at word boundaries: a chunk owns `CHUNK` starting positions and carries the n - 1 words after them, so that each run of words starts
in exactly one chunk. Chunks of long texts are dealt out anew and hashed anywhere; texts of one chunk are hashed where they lie, without a shuffle. Counts
and weights of chunks are summed by document. Hashes are taken once: a chunk's buckets are kept, two bytes each. What the driver sees are the counts of
the buckets, whatever the size of the corpus; ranks come from a range sort, where partitions' counts give the offsets.

Results in special cases. Null, empty and blank texts: no words, no features, weight 0, never drawn. Fewer words than a run has: the runs that there are. Empty table: no
rows. Empty target: every gain is against one in each bucket. Very long texts: whole, in chunks. Equal or null doc_ids: rows of their own, with equal noise;
a null id counts as an empty string there and comes last among ties. Equal rows: in any order. Ties: the smaller doc_id. Other columns, also of names used here, are ignored.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import done_with, numbered, partitions, small, stored, with_row_ids
from .simhash import LOWER

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: what the pattern on characters leaves
#: Starting positions that a chunk owns, and the characters from which a text may have more.
CHUNK, LONG = 4096, 8192
CHUNKS = "_rid bigint, own int, words binary"
HASHED = "_rid bigint, n_words bigint, n_features bigint, buckets binary"


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(LOWER))


def run_hashes(words: list[bytes], own: int, n: int) -> np.ndarray:
    """CRC-32s of the runs of 1 to n words that start at the first `own` of the words, in no particular order."""
    spaced = [b" " + w for w in words]
    now = list(map(crc32, words[:own]))
    out = [now]
    for k in range(1, n):
        now = list(map(crc32, spaced[k : own + k], now))  # goes on from the run that is one word shorter
        out.append(now)
    return np.fromiter((x for part in out for x in part), np.uint32, sum(map(len, out)))


def _hashed(n: int, buckets: int):
    """Rows of (_rid, own, words): what each holds. Without own, words are a whole text."""

    def run(batches):
        for batch in small(batches):
            whole = "own" not in batch.schema.names
            rids, rows = batch.column("_rid"), []
            owns = [None] * batch.num_rows if whole else batch.column("own").to_pylist()
            for own, text in zip(owns, batch.column("words").cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text or b"") if whole else (text.split(b" ") if text else [])
                own = len(words) if whole else own
                found = run_hashes(words, own, n)
                rows.append((own, len(found), np.sort(found % np.uint32(buckets)).astype("<u2").tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([rids, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["_rid", "n_words", "n_features", "buckets"])

    return run


def _chunked(n: int, size: int):
    def run(batches):
        for batch in small(batches, 16):
            for rid, text in zip(batch.column("_rid").to_pylist(), batch.column("words").cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                starts = range(0, max(1, len(words)), size)
                columns = [[rid] * len(starts), [min(size, len(words) - a) for a in starts], [b" ".join(words[a : a + size + n - 1]) for a in starts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["_rid", "own", "words"])

    return run


def chunks(texts: DataFrame, n: int = 3, size: int = CHUNK) -> DataFrame:
    """Chunks (_rid, own, words) of texts (_rid, words)."""
    return texts.mapInArrow(_chunked(n, size), CHUNKS)


def hashed(texts: DataFrame, n: int = 3, buckets: int = 10_000, long: int = LONG, size: int = CHUNK) -> DataFrame:
    """HASHED rows of texts (_rid, text), one for each chunk, stored. At most 65,536 buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be 1 to 65536")
    x = texts.select("_rid", F.col("text").cast("string").alias("words"))
    is_long = F.coalesce(F.length("words") > long, F.lit(False))
    near = x.where(~is_long).mapInArrow(_hashed(n, buckets), HASHED)
    cut = chunks(x.where(is_long), n, size).repartition(partitions(x.sparkSession), F.xxhash64("_rid", "words"))
    return stored(near.union(cut.mapInArrow(_hashed(n, buckets), HASHED)), "resample-chunks")


def bucket_counts(rows: DataFrame, buckets: int = 10_000) -> list[int]:
    """How often each bucket occurs in all of the chunks: summed in each task, then over tasks. The result has one number a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column("buckets"):
                total += np.bincount(np.frombuffer(b.as_buffer(), "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = dict(rows.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect())
    return [found.get(b, 0) for b in range(buckets)]


def gains(source: list[int], target: list[int]) -> list[int]:
    """The gain of each bucket, in thousandths."""
    s, t = float(sum(source) + len(source)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((y + 1) * s / ((x + 1) * t))) for x, y in zip(source, target, strict=True)]


def weighed(rows: DataFrame, gain: list[int]) -> DataFrame:
    """_rid, n_words, n_features and weight, summed over a document's chunks."""
    table = np.array(gain, np.int64)

    def run(batches):
        for batch in batches:
            sums = [int(table[np.frombuffer(b.as_buffer(), "<u2")].sum()) for b in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_rid", "n_words", "n_features")), pa.array(sums, pa.int64())], ["_rid", "n_words", "n_features", "weight"])

    parts = rows.mapInArrow(run, "_rid bigint, n_words bigint, n_features bigint, weight bigint")
    return parts.groupBy("_rid").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))


def noise(doc_id: F.Column, seed: int = 42) -> F.Column:
    """Gumbel noise of an id, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, n: int = 3, buckets: int = 10_000, seed: int = 42, least: int = 20, percent: int = 5) -> DataFrame:
    """doc_id, n_features, weight, score and rank of docs. The rank is null for those that are not drawn.

    target: texts of the wanted distribution. percent: of the documents with at least `least` words, how many are drawn.
    """
    texts = with_row_ids(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = hashed(texts, n, buckets)
    wanted = hashed(target.select(F.lit(0).cast("bigint").alias("_rid"), "text"), n, buckets)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    found = stored(weighed(rows, gain).join(texts.select("_rid", "doc_id"), "_rid").withColumn("score", score), "resample-weights")
    done_with(rows, wanted)
    able = found.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_rid")]
    place = numbered(able, order, "_place").where(F.col("_place") < drawn).select(F.col("_rid"), (F.col("_place") + 1).alias("rank"))
    return found.join(place, "_rid", "left").select("doc_id", "n_features", "weight", "score", "rank")


def oracle(buckets: int = 10_000, seed: int = 42, least: int = 20, percent: int = 5) -> str:
    """The same for runs of one to three words in DuckDB: CRC-32 byte by byte by its table, each run from the one that is a word shorter."""
    upper = "".join(map(chr, range(65, 91)))
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = "lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)"
    bucket = lambda state: f"xor({state}, 4294967295) % {buckets}"
    return f"""
    WITH crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
    texts AS MATERIALIZED (SELECT true AS own, row_number() OVER () AS id, doc_id, {words} AS w FROM documents
            UNION ALL SELECT false, row_number() OVER (), NULL, {words} FROM benchmark),
    runs AS MATERIALIZED (SELECT own, id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT own, id, w, unnest(range(1, len(w) + 1)) AS i FROM texts)),
    bytes AS MATERIALIZED (SELECT a AS w, list_transform(range(0, strlen(a)), lambda k: CAST('0x' || substr(hex(encode(a)), 2 * k + 1, 2) AS BIGINT)) AS x
            FROM (SELECT DISTINCT a FROM runs)),
    s1 AS MATERIALIZED (SELECT w AS a, list_reduce(list_prepend(4294967295::BIGINT, x), {step}) AS s FROM bytes, crc),
    s2 AS MATERIALIZED (SELECT a, b, list_reduce([s, 32] || x, {step}) AS s FROM (SELECT DISTINCT a, b FROM runs WHERE b IS NOT NULL) JOIN s1 USING (a) JOIN bytes ON w = b, crc),
    s3 AS MATERIALIZED (SELECT a, b, c, list_reduce([s, 32] || x, {step}) AS s FROM (SELECT DISTINCT a, b, c FROM runs WHERE c IS NOT NULL) JOIN s2 USING (a, b) JOIN bytes ON w = c, crc),
    found AS MATERIALIZED (SELECT own, id, {bucket('s')} AS k FROM runs JOIN s1 USING (a) UNION ALL SELECT own, id, {bucket('s')} FROM runs JOIN s2 USING (a, b)
            UNION ALL SELECT own, id, {bucket('s')} FROM runs JOIN s3 USING (a, b, c)),
    counts AS (SELECT k, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM found GROUP BY k),
    sums AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM counts),
    gains AS (SELECT k, CAST(floor(1000 * ln((counts.t + 1)::DOUBLE * (sums.s + {buckets}) / ((counts.s + 1)::DOUBLE * (sums.t + {buckets})))) AS BIGINT) AS gain FROM counts, sums),
    weights AS (SELECT id, count(*) AS n, sum(gain) AS weight FROM found JOIN gains USING (k) WHERE own GROUP BY id),
    scored AS (SELECT id, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
            CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM texts LEFT JOIN weights USING (id) WHERE own),
    able AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () * {percent} // 100 AS drawn FROM scored WHERE n_words >= {least})
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN able USING (id)"""
