"""Operator 9: an interpolated modified Kneser-Ney n-gram model, counted in Spark and read by memory map.

Three passes over the corpus, each in blocks of bounded size:

1. *Vocabulary.* Tasks count words in blocks and send (64-bit hash, count) to shards by hash range; a shard sums
   and writes its sorted hashes and counts as arrays. A word's id is its place in the order of hashes.
2. *N-grams.* Tasks look ids up in the memory-mapped vocabulary, count n-grams of the highest order in blocks and send them to shards by a
   hash of all of their words, so that the n-grams of a hot context spread over all shards. A shard sums and writes its sorted keys and counts. It sends
   on, to shards by context, what its n-grams add to their contexts (total, and how many have a count of one, two, three or more), and to shards
   of the next lower order how many different first words each rest has: the counts of that order. Hot contexts and words meet
   as sums of shards only. The discounts come from counts of counts, a few numbers for each shard.
3. *Scores.* Tasks map the arrays and look up each text's n-grams and contexts, sorted, shard by shard.

There are as many shards as SHARD_BYTES of text need, the shuffle partitions at least; a task takes one shard at a time. The arrays lie in the
shared scratch folder, which must be a mounted file system; a task writes under a name of its own and renames, so that lost or
repeated tasks leave whole files. P(w|v) sums to one over the vocabulary and one unknown word: in each order (c - D(c))/c(v) plus g(v) times the
probability of the next lower one, down to the uniform 1/(V+1). Words are known by 64-bit hashes, and so are n-grams of three words or more.

Results in special cases. Null or empty text: one token, the end. Null doc_id: counts as the text "" for its fold. Empty table, or no training
text: no counts, each token has probability 1/(V+1). Very long texts: whole, in a block of their own. Repeated rows and equal doc_ids: each
is counted and scored by itself. Extra columns, also of names used here, are ignored.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, scratch_path, small

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The end as a word: white space, which no word holds.
END = b"\n"
#: Tokens counted in one block.
BLOCK = 500_000
#: Bytes of training texts that one shard is meant for.
SHARD_BYTES = 64 << 20
FOLDS, HELD = 7, 2
SHARD = pa.schema([("shard", pa.int32()), ("data", pa.binary())])
TO_SHARD = "shard int, data binary"
#: A map keeps a descriptor of its own open unless told not to, which Python 3.13 and later can be.
_CLOSED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").translate(LOWER).split(), END]


def _blocks(batches, training: bool):
    """(ids, token lists) of up to about BLOCK tokens at a time."""
    ids, held, size = [], [], 0
    for batch in small(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if training and held_out(doc_id):
                continue
            ids.append(doc_id)
            held.append(tokens(text))
            size += len(held[-1])
            if size >= BLOCK:
                yield ids, held
                ids, held, size = [], [], 0
    if held:
        yield ids, held


def _numbered(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's distinct words, and the place among them of each token."""
    place: dict[bytes, int] = {}
    at = np.fromiter((place.setdefault(w, len(place)) for d in docs for w in d), np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place)), at


def _pack(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for b in blobs:
        n, at = int(np.frombuffer(b, "<i8", 1)[0]), 8
        for k, o in zip(kinds, out, strict=True):
            o.append(np.frombuffer(b, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(o) for o in out]


def _send(shard: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each shard; the columns must be sorted by shard."""
    cut = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
    ends = [*cut[1:], len(shard)] if cut else []
    data = [_pack(*(c[a:b] for c in columns)) for a, b in zip(cut, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int32()), pa.array(data, pa.binary())], schema=SHARD)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts).astype(np.int64)


def _range_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def _write(folder: str, name: str, array: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(own, array)
    os.replace(own, f"{folder}/{name}.npy")


@lru_cache(maxsize=20_000)
def _mapped(path: str) -> np.ndarray:
    """The array of a file by memory map; no file stays open, so that many shards do not use up a worker's descriptors."""
    with open(path, "rb") as f:
        np.lib.format.read_magic(f)
        shape, _, kind = np.lib.format.read_array_header_1_0(f)
        if not shape[0]:
            return np.zeros(0, kind)
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_CLOSED)
        return np.frombuffer(data, kind, shape[0], f.tell())


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def mounted(path: str) -> str:
    """A path that tasks can open, of a scratch path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the model's arrays are memory-mapped, so the shared folder must be a mounted file system, not {path}")
    return path


class Model:
    """What a worker needs: the folder, the shard count, the first id of each vocabulary shard, the order, and a few numbers."""

    def __init__(self, folder: str, shards: int, starts: list[int], total: int, order: int = 2):
        self.folder, self.shards, self.starts, self.total, self.order = folder, shards, np.array(starts, np.int64), total, order
        self.size = int(self.starts[-1])  # also the id of the start symbol, which no word has
        #: For each order from 1 the discounts of counts of one, two, and three or more.
        self.discounts: dict[int, tuple[float, float, float]] = {}
        self.contexts_all = 0
        self.uniform_weight = 1.0

    def array(self, name: str, shard: int) -> np.ndarray:
        return _mapped(f"{self.folder}/{name}-{shard}.npy")

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of words by their hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        shard = _range_shard(hashes[order], self.shards)
        for s in np.unique(shard).tolist():
            mine = order[slice(*np.searchsorted(shard, (s, s + 1)))]
            known = self.array("words", s)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[mine]), len(known) - 1)
                hit = known[at] == hashes[mine]
                ids[mine[hit]] = at[hit] + self.starts[s]
                counts[mine[hit]] = self.array("counts", s)[at[hit]]
        return ids, counts

    def grams(self, docs: list[list[bytes]], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row of `order` word ids for each token, its own last; texts begin with start symbols."""
        word = ids[at]
        lens = np.array([len(d) for d in docs], np.int64)
        inside = np.arange(len(word)) - np.repeat(np.cumsum(lens) - lens, lens)
        columns = [word]
        for back in range(1, self.order):
            shifted = np.full(len(word), self.size, np.int64)
            shifted[back:] = word[:-back]
            columns.insert(0, np.where(inside >= back, shifted, self.size))
        return np.stack(columns, axis=1)

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return (_mixed(keys) >> np.uint64(33)).astype(np.int64) % self.shards

    def continuation(self, word: np.ndarray) -> np.ndarray:
        """P(word) of the lowest order."""
        p = np.full(len(word), self.uniform_weight / (self.size + 1))
        known = np.flatnonzero(word >= 0)
        width = -(-self.size // self.shards) or 1
        by = np.argsort(word[known] // width, kind="stable")
        known = known[by]
        for s, mine in _split(word[known] // width, known):
            n = self.array("follows", s)[word[mine] - s * width].astype(np.int64)
            p[mine] += (n - np.array([0.0, *self.discounts[1]])[np.minimum(n, 3)]) / max(1, self.contexts_all)
        return p

    def found(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """Which keys an array has, and for each shard the places of the keys that it has, among `keys` and in the array."""
        shard = self.shard_of(keys)
        by = np.argsort(shard, kind="stable")
        hits, there = [], np.zeros(len(keys), bool)
        for s, mine in _split(shard[by], by):
            known = self.array(name, s)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
                hit = known[at] == keys[mine]
                there[mine[hit]] = True
                hits.append((s, mine[hit], at[hit]))
        return there, hits

    def probability(self, grams: np.ndarray) -> np.ndarray:
        """P(last word | the words before it) of rows of ids, of which -1 are unknown."""
        p = self.continuation(grams[:, -1])
        for k in range(2, self.order + 1):
            part = grams[:, -k:]
            known = np.flatnonzero((part[:, :-1] >= 0).all(axis=1))
            part = part[known]
            discount, count = np.array([0.0, *self.discounts[k]]), np.zeros(len(known), np.int64)
            last = np.flatnonzero(part[:, -1] >= 0)
            for s, mine, at in self.found(f"grams{k}", gram_keys(part[last], self.size))[1]:
                count[last[mine]] = self.array(f"counts{k}", s)[at]
            for s, mine, at in self.found(f"contexts{k}", gram_keys(part[:, :-1], self.size))[1]:
                total = self.array(f"totals{k}", s)[at].astype(np.float64)
                left = sum(discount[n] * self.array(f"n{n}_{k}", s)[at] for n in (1, 2, 3)) / total
                c, here = count[mine], known[mine]
                p[here] = (c - discount[np.minimum(c, 3)]) / total + left * p[here]
        return p


def _split(shard: np.ndarray, rows: np.ndarray):
    """(shard, its rows) of rows that are sorted by shard."""
    cut = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
    for a, b in zip(cut, [*cut[1:], len(shard)], strict=True):
        yield int(shard[a]), rows[a:b]


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Keys with their bits spread over all of the number."""
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(29))


def gram_keys(grams: np.ndarray, size: int) -> np.ndarray:
    """Rows of ids as sortable numbers: one or two ids exactly, while the vocabulary has fewer than 2^32 words, three or more as a hash."""
    if size >= 1 << 32:
        raise ValueError("the vocabulary has 2^32 words or more")
    ids = grams.astype(np.uint64)
    if ids.shape[1] == 1:
        return ids[:, 0]
    keys = (ids[:, 0] << np.uint64(32)) | ids[:, 1]
    for k in range(2, ids.shape[1]):
        keys = _mixed(_mixed(keys) + ids[:, k] + np.uint64(k))
    return keys


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more; kept within (0, count]."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.01), float(k)) for k, d in enumerate(raw, 1))  # type: ignore[return-value]


def _count_words(shards: int):
    def run(batches):
        for _, docs in _blocks(batches, True):
            hashes, at = _numbered(docs)
            keys, counts = _summed(hashes, np.bincount(at, minlength=len(hashes)))
            yield _send(_range_shard(keys, shards), keys, counts)

    return run


def _merge_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _summed(*_unpack(table.column("data").to_pylist(), "<u8", "<i8"))
        _write(folder, f"words-{shard}", keys)
        _write(folder, f"counts-{shard}", _small(counts))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    return run


def _grouped(grams: np.ndarray, values: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Equal rows of ids with their values added up, sorted by key: keys, rows, sums."""
    keys = gram_keys(grams, size)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order], first) if len(first) else v.astype(np.int64) for v in values]
    return keys[first], grams[order[first]], sums


def _sent(model: Model, keys: np.ndarray, grams: np.ndarray, *values: np.ndarray, kind: str = "<u4") -> pa.RecordBatch:
    """Ids and values, to shards by key. What one block or shard counts of an n-gram has 32 bits."""
    shard = model.shard_of(keys)
    order = np.argsort(shard, kind="stable")
    return _send(shard[order], *(grams[order, k].astype("<u4") for k in range(grams.shape[1])), *(v[order].astype(kind) for v in values))


def _received(table: pa.Table, words: int, values: int, kind: str = "<u4") -> tuple[np.ndarray, list[np.ndarray]]:
    columns = _unpack(table.column("data").to_pylist(), *["<u4"] * words, *[kind] * values)
    return np.stack(columns[:words], axis=1).astype(np.int64), [v.astype(np.int64) for v in columns[words:]]


def _count_grams(model: Model):
    def run(batches):
        for _, docs in _blocks(batches, True):
            hashes, at = _numbered(docs)
            grams = model.grams(docs, model.look_up(hashes)[0], at)
            keys, grams, (counts,) = _grouped(grams, [np.ones(len(grams), np.int64)], model.size)
            yield _sent(model, keys, grams, counts)

    return run


GRAM_STATS = "kind string, shard int, data binary, n1 bigint, n2 bigint, n3 bigint, n4 bigint"


def _merge_grams(model: Model, order: int):
    """Write a shard's n-grams, and send on what they add to their contexts and to the next lower order."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        grams, values = _received(table, order, 1)
        keys, grams, (counts,) = _grouped(grams, values, model.size)
        _write(model.folder, f"grams{order}-{shard}", keys)
        _write(model.folder, f"counts{order}-{shard}", _small(counts))
        tops = [(counts == n if n < 3 else counts >= 3).astype(np.int64) for n in (1, 2, 3)]
        keys, contexts, sums = _grouped(grams[:, :-1], [counts, *tops], model.size)
        to_contexts = _sent(model, keys, contexts, *sums, kind="<i8")
        keys, rest, (firsts,) = _grouped(grams[:, 1:], [np.ones(len(grams), np.int64)], model.size)
        if order > 2:
            lower = _sent(model, keys, rest, firsts)
        else:
            width = -(-model.size // model.shards) or 1
            lower = _send(rest[:, 0] // width, rest[:, 0], firsts)
        stats = pa.table({"kind": ["count"], "shard": pa.array([shard], pa.int32()), "data": pa.array([None], pa.binary()), **{f"n{k}": pa.array([int((counts == k).sum())], pa.int64()) for k in (1, 2, 3, 4)}})
        more = []
        for kind, sent in (("context", to_contexts), ("lower", lower)):
            zero = pa.array([0] * len(sent), pa.int64())
            more.append(pa.table({"kind": pa.array([kind] * len(sent), pa.string()), "shard": sent.column("shard"), "data": sent.column("data"), **{f"n{k}": zero for k in (1, 2, 3, 4)}}))
        return pa.concat_tables([stats, *more])

    return run


def _merge_contexts(model: Model, order: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, _, sums = _grouped(*_received(table, order - 1, 4, "<i8"), model.size)
        _write(model.folder, f"contexts{order}-{shard}", keys)
        for name, v in zip((f"totals{order}", *(f"n{n}_{order}" for n in (1, 2, 3))), sums, strict=True):
            _write(model.folder, f"{name}-{shard}", _small(v))
        return pa.table({"shard": pa.array([shard], pa.int32())})

    return run


def _merge_follows(model: Model):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        words, n = _summed(*_unpack(table.column("data").to_pylist(), "<i8", "<i8"))
        width = -(-model.size // model.shards) or 1
        dense = np.zeros(max(0, min(width, model.size - shard * width)), np.int64)
        dense[words - shard * width] = n
        _write(model.folder, f"follows-{shard}", _small(dense))
        out = {"total": int(n.sum())} | {f"n{k}": int((n == k).sum()) for k in (1, 2, 3, 4)} | {"more": int((n >= 3).sum())}
        return pa.table({k: pa.array([x], pa.int64()) for k, x in out.items()})

    return run


def train(docs: DataFrame, order: int = 2) -> Model:
    """Count the training texts of docs (doc_id, text) and write the arrays of a model of `order` words, two at least."""
    from .shared import stored

    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // SHARD_BYTES))
    folder = mounted(scratch_path(spark, "lm"))

    def complete(there, kinds: dict[str, type]) -> None:
        """Empty arrays for the shards that got nothing."""
        for s in set(range(shards)) - set(there):
            for name, kind in kinds.items():
                _write(folder, f"{name}-{s}", np.zeros(0, kind))

    words = docs.mapInArrow(_count_words(shards), TO_SHARD).groupBy("shard").applyInArrow(_merge_words(folder), "shard int, n bigint, total bigint")
    sizes = {r["shard"]: r for r in words.collect()}  # a row for each shard
    complete(sizes, {"words": np.uint64, "counts": np.uint8})
    starts = np.cumsum([0, *(sizes[s]["n"] if s in sizes else 0 for s in range(shards))]).tolist()
    model = Model(folder, shards, starts, sum(r["total"] for r in sizes.values()), order)
    sent = docs.mapInArrow(_count_grams(model), TO_SHARD)
    for k in range(order, 1, -1):
        made = stored(sent.groupBy("shard").applyInArrow(_merge_grams(model, k), GRAM_STATS), f"lm-{k}")
        n = made.where("kind = 'count'").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in (1, 2, 3, 4)), F.collect_set("shard").alias("shards")).first()
        complete(n["shards"], {f"grams{k}": np.uint64, f"counts{k}": np.uint8})
        model.discounts[k] = discounts(*(n[f"n{i}"] or 0 for i in (1, 2, 3, 4)))
        contexts = made.where("kind = 'context'").select("shard", "data").groupBy("shard").applyInArrow(_merge_contexts(model, k), "shard int")
        complete((r["shard"] for r in contexts.collect()), {f"contexts{k}": np.uint64, f"totals{k}": np.uint8, **{f"n{i}_{k}": np.uint8 for i in (1, 2, 3)}})
        sent = made.where("kind = 'lower'").select("shard", "data")
    low = sent.groupBy("shard").applyInArrow(_merge_follows(model), "total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint")
    low = low.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in low.columns)).first()
    model.discounts[1] = discounts(*(low[f"n{k}"] for k in (1, 2, 3, 4)))
    model.contexts_all = low["total"]
    if low["total"]:
        model.uniform_weight = sum(d * n for d, n in zip(model.discounts[1], (low["n1"], low["n2"], low["more"]), strict=True)) / low["total"]
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (the model), of each text."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        for ids, docs in _blocks(batches, False):
            hashes, at = _numbered(docs)
            word_ids, counts = model.look_up(hashes)
            lens = np.array([len(d) for d in docs], np.int64)
            starts = np.cumsum(lens) - lens
            c = counts[at]
            base = np.add.reduceat(np.log10((c + 1) / (model.total + model.size + 1)), starts)
            grams = model.grams(docs, word_ids, at)
            # equal n-grams are looked up once; unknown ids move from -1 to zero
            _, one, back = np.unique(gram_keys(grams + 1, model.size), return_index=True, return_inverse=True)
            whole = np.add.reduceat(np.log10(model.probability(grams[one]))[back], starts)
            columns = [ids, [held_out(i) for i in ids], lens, np.add.reduceat((c > 0).astype(np.int64), starts), [model.total] * len(ids), base, whole]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def perplexity(docs: DataFrame, order: int = 2) -> DataFrame:
    """Train on all folds of docs but the held-out one, and score all of its texts."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(docs, train(docs, order))
