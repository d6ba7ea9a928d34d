"""Operator 8: remove every byte that a long string repeated from an earlier place covers.

A string of `width` bytes is removed where it also starts earlier (smaller doc_id, or the same document and
an earlier start). The work is cut so that no task ever holds more than a bounded block:

1. *Anchors.* In each window of `width` bytes the k-gram with the smallest hash is its anchor, so equal
   windows have the same anchor at the same offset. Neighbouring windows share anchors; one record stands for
   such a run of windows: the anchor's hash, a hash of all bytes that the run covers, and its place.
   A task keeps the first record of equal runs and marks the others at once, so that a passage that a third
   of all rows share leaves a task once. Records go to shards by their anchor's hash.
2. *Runs.* A shard marks all but the first of equal runs. Runs with an anchor that other runs share, but not
   all of their bytes, are asked for again: their windows may match in part.
3. *Windows.* The bytes of these runs meet by anchor in shards. For each block of anchors a shard builds a run-compressed Burrows-Wheeler
   transform with samples at the ends of its runs, streams matching statistics from it over the bytes, and marks
   all but the earliest of the windows that long matches join; the index alone decides. An anchor with very many different runs (a
   frequent short line) spreads over all shards by the hash of each window instead, again with only the first
   of a task sent on.
4. *Removal.* Marks join the documents by id.

There are as many shards of runs as SHARD_BYTES of text need, and of windows as WINDOW_BYTES of what is asked for need, the shuffle
partitions at least; a task takes one shard at a time, and of its windows INDEX_BYTES at a time.

Results in special cases. Null or empty text: nothing to remove. Empty table: no rows. Very long texts: whole, hashed in parts of bounded
size. Repeated rows: all but the first are removed. Rows with equal or null doc_ids are told apart by shared.with_row_ids (order: doc_id, nulls
last, then text), and so are ties. Other columns, also of names used here, are kept as they are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keeps_columns, let_go, partitions, small, stored, trim, with_row_ids

GRAM = 40
#: Bytes that are hashed at once, and the longest part of a text among them.
CHUNK, PART = 1 << 20, 1 << 19
#: Records that a task gathers before it sends them on; different runs of an anchor in one such block, or in
#: one shard, from which its windows are dealt out singly.
BLOCK, HOT_BLOCK, HOT_SHARD = 400_000, 32, 4096
#: Bytes of texts whose records one shard is meant for, bytes of runs and records of windows that one shard is meant for, and bytes that one index
#: holds, besides those of its last anchors (HOT_SHARD runs of each at most). An index takes some 80 bytes of memory for each.
SHARD_BYTES, WINDOW_BYTES, INDEX_BYTES = 16 << 20, 8 << 20, 1 << 19
_BASE = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(CHUNK + PART + 4096)


def anchor_runs(buf: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor hash of each run of windows with one anchor; no window crosses owners."""
    n, grams = len(buf), width - GRAM + 1
    if n < width:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << 21) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal k-grams
    size = 1
    while size * 2 <= grams:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < grams:
        key = np.minimum(key[: len(key) - (grams - size)], key[grams - size :])
    at = (key & low).astype(np.int64)
    inside = owner[: n - width + 1] == owner[width - 1 :]
    change = at[1:] != at[:-1]
    first = inside & np.concatenate(([True], change | ~inside[:-1]))
    last = inside & np.concatenate((change | ~inside[1:], [True]))
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    return s, e, h[at[s]]


def _merge(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals for each rid, sorted."""
    if not len(rid):
        return rid, start, end
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    # a running maximum of the ends within each rid: lift each rid above all ends of those before it
    group = np.concatenate(([0], np.cumsum(rid[1:] != rid[:-1])))
    lift = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * lift)
    new = np.concatenate(([True], start[1:] + group[1:] * lift > reach[:-1]))
    first = np.flatnonzero(new)
    stop = np.concatenate((first[1:] - 1, [len(rid) - 1]))
    return rid[first], start[first], reach[stop] - group[stop] * lift


#: What is sent, by kind. Places and sizes take 4 bytes, as no text has 2 GB.
RUN = ("<u8", "<u8", "<i8", "<u4", "<u4", "u1")  # anchor, content, rid, start, windows - 1, anchor is hot
MARK = ("<i8", "<u4", "<u4")  # rid, start, end
BYTES = ("<u2", "<i8", "<u4", "<u4")  # 16 bits of the anchor, rid, start, size
WINDOW = ("<u8", "<u8", "<i8", "<u4")  # content (two), rid, start
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
ASK = np.dtype([("start", "<u4"), ("more", "<u4"), ("anchor", "<u8"), ("hot", "u1")])  # more: windows - 1


def _pack(kinds: tuple[str, ...], *columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(columns, kinds, strict=True))


def _unpack(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    """The columns of all blobs, with places and sizes as 64-bit integers."""
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for b in blobs:
        n, at = int(np.frombuffer(b, "<i8", 1)[0]), 8
        for k, o in zip(kinds, out, strict=True):
            o.append(np.frombuffer(b, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(o).astype(np.int64 if k == "<u4" else k, copy=False) for k, o in zip(kinds, out, strict=True)]


SHARDS = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
FOUND = pa.schema([("_rid", pa.int64()), ("marks", pa.binary()), ("asks", pa.binary()), ("asked", pa.int64())])
TO_SHARD, TO_FOUND = "shard int, kind string, data binary", "_rid bigint, marks binary, asks binary, asked bigint"


def _groups(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal keys."""
    cut = np.flatnonzero(_fresh(sorted_keys)).tolist()
    return list(zip(cut, [*cut[1:], len(sorted_keys)], strict=False)) if cut else []


def _dealt(kind: str, kinds: tuple[str, ...], shard: np.ndarray, columns: list[np.ndarray]):
    """One row for each shard with its part of the columns."""
    order = np.argsort(shard, kind="stable")
    for a, b in _groups(shard[order]):
        yield int(shard[order[a]]), kind, _pack(kinds, *(c[order[a:b]] for c in columns))


def _batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SHARDS)], schema=SHARDS)


def _fresh(*keys: np.ndarray) -> np.ndarray:
    """True where any key differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _first_of(order_by: tuple, rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by keys then place, and whether each is the first with its keys."""
    order = np.lexsort((start, rid, *reversed(order_by)))
    return order, _fresh(*(k[order] for k in order_by))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    text = batch.column("text")
    return [t or b"" for t in text.cast(pa.binary()).to_pylist()]


def _send_anchors(width: int, shards: int):
    def flush(runs: list[tuple]):
        h, sw, rid, s, n = (np.concatenate(c) for c in zip(*runs, strict=True))
        order, new = _first_of((h, sw), rid, s)
        h, sw, rid, s, n = (c[order] for c in (h, sw, rid, s, n))
        mark = _merge(rid[~new], s[~new], s[~new] + n[~new].astype(np.int64) + width)
        if len(mark[0]):
            yield from _dealt("mark", MARK, (mark[0] % shards).astype(np.int32), list(mark))
        h, sw, rid, s, n = (c[new] for c in (h, sw, rid, s, n))
        lead = np.flatnonzero(_fresh(h))
        count = np.diff(np.concatenate((lead, [len(h)])))
        hot = np.repeat(count >= HOT_BLOCK, count)
        away = hot.copy()
        away[lead] = False  # one of a hot anchor tells its shard that it is hot
        shard = (np.where(away, sw, h) % np.uint64(shards)).astype(np.int32)
        yield from _dealt("run", RUN, shard, [h, sw, rid, s, n, hot.astype(np.uint8)])

    def send(batches):
        let_go()
        runs, held = [], 0
        for batch in small(batches):
            parts: list[tuple[int, int, bytes]] = []
            size = 0

            def hashed(parts):
                data = b"".join(p[2] for p in parts)
                lens = np.array([len(p[2]) for p in parts])
                ends = np.cumsum(lens)
                s, e, h = anchor_runs(np.frombuffer(data, np.uint8), np.repeat(np.arange(len(parts)), lens), width)
                part = np.searchsorted(ends, s, side="right")
                view = memoryview(data)
                sw = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(s.tolist(), (e + width).tolist(), strict=True)], np.uint64)
                rid = np.array([p[0] for p in parts], np.int64)[part]
                base = np.array([p[1] for p in parts], np.int64) - (ends - lens)
                return h, sw, rid, s + base[part], (e - s).astype(np.uint32)

            for rid, text in zip(batch.column("_rid").to_pylist(), _texts(batch), strict=True):
                for a in range(0, len(text) - width + 1, PART):
                    parts.append((rid, a, text[a : a + PART + width - 1]))
                    size += len(parts[-1][2])
                    if size >= CHUNK:
                        runs.append(hashed(parts))
                        held += len(runs[-1][0])
                        parts, size = [], 0
                        if held >= BLOCK:
                            yield _batch(flush(runs))
                            runs, held = [], 0
                            trim()
            if parts:
                runs.append(hashed(parts))
                held += len(runs[-1][0])
        if held:
            yield _batch(flush(runs))

    return send


def _of_each(rids: np.ndarray, rid: np.ndarray, kind: np.dtype, *columns: np.ndarray) -> pa.Array:
    """For each of the sorted rids its rows, as the bytes of an array of that kind; null where it has none."""
    order = np.argsort(rid, kind="stable")
    rows = np.empty(len(rid), kind)
    for name, c in zip(kind.names, columns, strict=True):
        rows[name] = c[order]
    ends = np.searchsorted(rid[order], rids, side="right")
    has = np.packbits(np.diff(ends, prepend=0) > 0, bitorder="little")
    at = (np.append(0, ends) * kind.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rids), [pa.py_buffer(x) for x in (has, at, rows.view(np.uint8))])


def _found(mark: tuple, rid: np.ndarray, ask: list[np.ndarray], width: int) -> pa.Table:
    """One row for each rid with marks or asks; asked: the bytes that its asks send."""
    mrid, ms, me = _merge(*mark)
    rids = np.union1d(mrid, rid)
    _, more, _, hot = ask
    size = np.bincount(np.searchsorted(rids, rid), np.where(hot > 0, 32 * (more + 1.0), more + float(width)), len(rids))
    columns = [pa.array(rids), _of_each(rids, mrid, SPAN, ms, me), _of_each(rids, rid, ASK, *ask), pa.array(size.astype(np.int64))]
    return pa.Table.from_arrays(columns, schema=FOUND)


def _by_kind(table: pa.Table) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        out.setdefault(kind, []).append(data)
    return out


def _compare_runs(width: int):
    def compare(table: pa.Table) -> pa.Table:
        trim()
        blobs = _by_kind(table)
        mark = _unpack(blobs.get("mark", []), *MARK)
        h, sw, rid, s, n, hot = _unpack(blobs.get("run", []), *RUN)
        order, new = _first_of((h, sw), rid, s)
        h, sw, rid, s, n, hot = (c[order] for c in (h, sw, rid, s, n, hot))
        mark = [np.concatenate(x) for x in zip(mark, (rid[~new], s[~new], s[~new] + n[~new].astype(np.int64) + width), strict=True)]
        # a hot run that was sent away from its anchor's shard may have equal runs elsewhere; windows settle that
        lead = np.flatnonzero(_fresh(h))
        count = np.diff(np.concatenate((lead, [len(h)])))
        told = np.add.reduceat(hot.astype(np.int64), lead) > 0 if len(lead) else np.zeros(0, bool)
        many = np.add.reduceat(new.astype(np.int64), lead) if len(lead) else np.zeros(0, np.int64)
        shared, big = np.repeat((many > 1) | told, count), np.repeat(told | (many > HOT_SHARD), count)
        keep = new & shared
        return _found(tuple(mark), rid[keep], [s[keep], n[keep], h[keep], big[keep].astype(np.uint8)], width)

    return compare


def _send_windows(width: int, shards: int):
    def flush(plain: list[tuple], singles: list[tuple]):
        if plain:
            h = np.array([x[0] for x in plain], np.uint64)
            shard = (h % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            for a, b in _groups(shard[order]):
                own = [plain[i] for i in order[a:b]]
                part = h[order[a:b]] >> np.uint64(24)  # what meets by anchor meets by these bits too
                head = _pack(BYTES, part, *(np.array([x[i] for x in own], np.int64) for i in (1, 2)), np.array([len(x[3]) for x in own], np.int64))
                yield int(shard[order[a]]), "bytes", head + b"".join(x[3] for x in own)
        if singles:
            a, b, rid, s = (np.concatenate(c) for c in zip(*singles, strict=True))
            order, new = _first_of((a, b), rid, s)
            a, b, rid, s = (c[order] for c in (a, b, rid, s))
            mark = _merge(rid[~new], s[~new], s[~new] + width)
            if len(mark[0]):
                yield from _dealt("mark", MARK, (mark[0] % shards).astype(np.int32), list(mark))
            yield from _dealt("window", WINDOW, (a[new] % np.uint64(shards)).astype(np.int32), [c[new] for c in (a, b, rid, s)])

    def send(batches):
        trim()
        plain, singles, held = [], [], 0
        for batch in small(batches):
            for rid, text, asks in zip(batch.column("_rid").to_pylist(), _texts(batch), batch.column("_asks").to_pylist(), strict=True):
                for s, n, h, hot in np.frombuffer(b"".join(asks), ASK).tolist():
                    if hot:
                        ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[p : p + width]) for p in range(s, s + n + 1)), "<u8").reshape(-1, 2)
                        singles.append((ids[:, 0], ids[:, 1], np.full(n + 1, rid, np.int64), np.arange(s, s + n + 1)))
                        held += n + 1
                    else:
                        plain.append((h, rid, s, text[s : s + n + width]))
                        held += 4
                if held >= BLOCK:
                    yield _batch(flush(plain, singles))
                    plain, singles, held = [], [], 0
                    trim()
        if held:
            yield _batch(flush(plain, singles))

    return send


def suffix_order(buf: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in their order, by doubling the sorted depth of those that are still tied."""
    n = len(buf)
    symbols = np.zeros(n + 7, np.uint64)  # zero stands past the end only, so no two suffixes are equal
    symbols[:n] = buf
    symbols[:n] += np.uint64(1)
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | symbols[i : i + n]
    order, rank = np.argsort(key, kind="stable"), np.zeros(n + 1, np.int64)
    slots, at, key, depth = np.arange(n), order, key[order], 7
    while len(slots):
        head = _fresh(key)
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))] + 1
        slots = slots[~(head & np.append(head[1:], True))]
        at = order[slots]
        key = (rank[at] << 32) | rank[np.minimum(at + depth, n)]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        depth *= 2
    return order


class RunIndex(NamedTuple):
    """A run-compressed Burrows-Wheeler transform: the symbol (a byte, or 256 before the first) and length of each run, and
    samples of the suffix order at the run's head and at the end of the run before (-1: none)."""

    symbol: np.ndarray
    length: np.ndarray
    head: np.ndarray
    end_before: np.ndarray


def run_length_index(buf: np.ndarray, order: np.ndarray) -> RunIndex:
    before = np.concatenate((np.full(min(len(buf), 1), 256, np.int16), buf[:-1]))[order]
    first = np.flatnonzero(_fresh(before))
    ends = np.concatenate(([-1], order[first[1:] - 1]))[: len(first)]
    return RunIndex(before[first], np.diff(np.append(first, len(buf))), order[first], ends)


def _common(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common (none where b is negative)."""
    n, out, at = len(buf), np.zeros(len(a), np.int64), 0
    words = np.ndarray((n + 1,), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    live = np.flatnonzero(b >= 0)
    while len(live):
        i, j = a[live] + at, b[live] + at
        differ = words[i] ^ words[j]
        same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8  # 8 where nothing differs
        got = np.minimum(same, n - np.maximum(i, j))
        out[live] += got
        live, at = live[got == 8], at + 8
    return out


def matching_statistics(buf: np.ndarray, index: RunIndex) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of its match with the suffix before it in the order, and where that one starts.

    Bytes are compared at the samples only. From there both places step on together through the text, and the match
    shrinks by one byte a step, until the next sample: within a run the order of suffixes is that of their tails.
    """
    by = np.argsort(index.head)
    place, other = index.head[by], index.end_before[by]
    reach = np.diff(np.append(place, len(buf)))
    step = np.arange(len(buf)) - np.repeat(place, reach)
    return np.repeat(_common(buf, place, other), reach) - step, np.repeat(other, reach) + step


def later_windows(buf: np.ndarray, fits: np.ndarray, width: int) -> np.ndarray:
    """Places of the windows among `fits` whose `width` bytes also start at an earlier one of them.

    The order of suffixes is there until the index has its samples. All that follows comes from the index: a match of `width` bytes or
    more joins a place to the one that it matches, and the places that lead to the same one share their bytes.
    """
    index = run_length_index(buf, suffix_order(buf))
    length, other = matching_statistics(buf, index)
    to = np.where(length >= width, other, np.arange(len(buf)))
    while True:
        further = to[to]
        if (further == to).all():
            break
        to = further
    places = np.flatnonzero(fits)
    earliest = np.full(len(buf), len(buf))
    np.minimum.at(earliest, to[places], places)
    return places[places != earliest[to[places]]]


def _blocks(part: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of blocks of INDEX_BYTES of runs, which end with the last run of a part (parts are sorted)."""
    lead = np.flatnonzero(_fresh(part))
    count, total = np.diff(np.append(lead, len(part))), np.add.reduceat(size, lead)
    return _groups(np.repeat((np.cumsum(total) - total) // INDEX_BYTES, count))


def _compare_windows(width: int):
    def compare(table: pa.Table) -> pa.Table:
        trim()
        blobs = _by_kind(table)
        marks = [_unpack(blobs.get("mark", []), *MARK)]
        a, b, rid, s = _unpack(blobs.get("window", []), *WINDOW)
        order, new = _first_of((a, b), rid, s)
        old = order[~new]
        marks.append([rid[old], s[old], s[old] + width])
        runs, data = [], [np.zeros(0, np.uint8)]
        for x in blobs.get("bytes", []):
            runs.append(_unpack([x], *BYTES))
            data.append(np.frombuffer(x, np.uint8, offset=8 + sum(np.dtype(k).itemsize for k in BYTES) * len(runs[-1][0])))
        if runs:
            part, rid, s, n = (np.concatenate(c) for c in zip(*runs, strict=True))
            raw, at = np.concatenate(data), np.cumsum(n) - n
            place = np.lexsort((s, rid, part))  # an index holds the runs of an anchor in the order of the corpus
            part, rid, s, n, at = (c[place] for c in (part, rid, s, n, at))
            for i, j in _blocks(part, n):
                size = n[i:j]
                spread = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                buf = raw[np.repeat(at[i:j], size) + spread]
                old = later_windows(buf, spread + width <= np.repeat(size, size), width)  # windows within one run's bytes
                owner = i + np.repeat(np.arange(j - i), size)[old]
                where = s[owner] + spread[old]
                marks.append(_merge(rid[owner], where, where + width))
        none = np.zeros(0, np.int64)
        return _found(tuple(np.concatenate(x) for x in zip(*marks, strict=True)), none, [none] * 4, width)

    return compare


def _cut_out(text: bytes, marks: list[bytes]) -> tuple[int, int, bytes]:
    span = np.frombuffer(b"".join(marks), SPAN)
    _, start, end = _merge(np.zeros(len(span), np.int64), *(span[x].astype(np.int64) for x in SPAN.names))
    view, at, kept = memoryview(text), 0, []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        kept.append(view[at:a])
        at = b
    kept.append(view[at:])
    return int((end - start).sum()), len(start), b"".join(kept)


def _remove(schema: pa.Schema):
    whole = schema.field("_kept").type

    def remove(batches):
        trim()
        for batch in small(batches):
            out = [_cut_out(t, m or []) for t, m in zip(_texts(batch), batch.column("_marks").to_pylist(), strict=True)]
            kept = [x[2] for x in out] if whole == pa.binary() else [x[2].decode("utf-8", "ignore") for x in out]
            columns = [batch.column(f.name).cast(f.type) for f in schema if f.name in batch.schema.names]
            more = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(kept, whole)]
            yield pa.RecordBatch.from_arrays([*columns, *more], schema=schema)

    return remove


def remove_repeats(docs: DataFrame, width: int = 100, as_text: bool = False) -> DataFrame:
    """docs with _removed (bytes), _spans (maximal removed runs of bytes) and _kept (the remaining bytes).

    as_text: _kept is a string, without the parts of characters that a cut splits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(partitions(spark), -(-size // SHARD_BYTES))
    docs = with_row_ids(docs.drop("_removed", "_spans", "_kept", "_marks", "_asks", "_rid"))
    runs = docs.select("_rid", "text").mapInArrow(_send_anchors(width, shards), TO_SHARD)
    found = stored(runs.groupBy("shard").applyInArrow(_compare_runs(width), TO_FOUND), "repeats")
    asks = found.where("asks is not null").groupBy("_rid").agg(F.collect_list("asks").alias("_asks"))
    # all columns of docs, so that this join and the last one share one shuffle of the texts
    shards = max(partitions(spark), -(-(found.agg(F.sum("asked")).first()[0] or 0) // WINDOW_BYTES))
    windows = docs.join(asks, "_rid").mapInArrow(_send_windows(width, shards), TO_SHARD)
    settled = windows.groupBy("shard").applyInArrow(_compare_windows(width), TO_FOUND)
    marks = found.unionByName(settled).where("marks is not null").groupBy("_rid").agg(F.collect_list("marks").alias("_marks"))
    schema = docs.selectExpr("*", "0L _removed", "0L _spans", "'' _kept" if as_text else "binary('') _kept").schema
    removed = docs.join(marks, "_rid", "left").mapInArrow(_remove(to_arrow_schema(schema)), schema)
    return removed.drop("_rid")


@keeps_columns
def without_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """docs with the repeats cut from their texts (a character that a cut splits goes too) and n_chars to match."""
    cut = remove_repeats(docs, width, as_text=True)
    changed = F.col("_removed") > 0
    cut = cut.withColumn("text", F.when(changed, F.col("_kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)
