"""Operator 11: codes for vectors by one small codebook for each part of them, trained with Lloyd's rounds and Hamerly's bounds.

A component x becomes the integer floor(scale * x), and a vector is cut into equal consecutive parts. Each part keeps, from round to round, its
entry, an upper bound of its distance to that entry and a lower bound of the distance to its second-nearest one. When the entries have moved, the upper
bound grows by the move of the own entry and the lower one shrinks by the largest move of another. A part stays where it is if its upper bound is
strictly below its lower bound, or strictly below half of the way from its entry to the nearest other one; first with the bound as it is, then with
the exact distance. Only if both fail are all entries scanned. Bounds are 32-bit floats rounded outwards, distances are exact integers, and a part that
is as near to another entry as to its own never passes a strict test: so a tie always goes to the lower index, as without bounds.

A round is one pass over the vectors. It writes the parts' state anew and, in the same rows, what each task adds to the entries' sums, of which
Spark adds up parts x entries x (width + 1) numbers, whatever the number of vectors; the driver has these sums and the codebooks only. The state of the
round before is deleted once that of the next is written.

Results in special cases. Vectors that are null, or hold nulls, NaN or infinities, are dropped. Null vec_ids: kept, after all others. Equal vec_ids: rows of
their own; among the first entries they are ordered by vector. Fewer vectors than entries: as many entries as vectors. Equal first entries: the lower index
takes all, the other stays. Empty table, or none kept: no rows. Null labels are one label. Other columns, also of names used here, are ignored. Vectors of
unlike widths, or of one that the parts don't divide, and components whose squared distances would pass 62 bits, are an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import done_with, small, stored

#: Labels up to which their sums are sent to all tasks; more are joined by a salted shuffle.
FEW_LABELS, SALTS = 100_000, 32
#: Rows whose parts are worked on at once.
AT_ONCE = 8192
_UP, _DOWN = np.float32(np.inf), np.float32(-np.inf)


@dataclass
class Codes:
    """rows: vec_id, label, codes (array<int>), error. books: entries by part, entry and position. scanned: by pass, the parts whose entries were all scanned."""

    rows: DataFrame
    books: np.ndarray
    scanned: list[int]


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v (doubles) of the vectors that are kept."""
    v = F.col("embedding").cast("array<double>")
    x = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), v.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return x.where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), _UP)


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), _DOWN)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    apart = x[:, None, :] - entries[None, :, :]
    return np.einsum("nkw,nkw->nk", apart, apart)


@dataclass
class _Moves:
    """What the bounds need of the entries: their move since the last pass, the largest move of the others, half of the way to the nearest other."""

    own: np.ndarray
    others: np.ndarray
    half: np.ndarray

    @staticmethod
    def of(old: np.ndarray, new: np.ndarray) -> _Moves:
        parts, count, _ = new.shape
        own = _above(np.sqrt(((new - old) ** 2).sum(-1)))
        others, half = np.zeros((parts, count), np.float32), np.full((parts, count), np.inf, np.float32)
        for k in range(count if count > 1 else 0):
            rest = np.arange(count) != k
            others[:, k] = own[:, rest].max(1)
            half[:, k] = _below(np.sqrt(((new[:, rest] - new[:, k : k + 1]) ** 2).sum(-1).min(1)) / 2)
        return _Moves(own, others, half)


def _integers(column: pa.Array, width: int, scale: int | None) -> np.ndarray:
    """Rows of integers; of doubles to be scaled, or of integers already."""
    flat, rows = column.flatten().to_numpy(zero_copy_only=False), len(column)
    if len(flat) != rows * width or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError(f"all vectors must be {width} wide")
    return (np.floor(flat * float(scale)) if scale else flat).reshape(rows, width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _assigned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a part's rows: the nearest entry (the lower of equals), its squared distance and that of the second-nearest."""
    d = _squares(x, entries)
    code = d.argmin(1)
    at = np.arange(len(x))
    best = d[at, code]
    d[at, code] = np.iinfo(np.int64).max
    return code, best, d.min(1)


def _passed(books: np.ndarray, moves: _Moves | None, scale: int | None, label: pa.DataType, final: bool):
    """One pass: assigns the parts, with bounds unless it is the first, and adds up what is assigned."""
    parts, count, width = books.shape
    most = math.isqrt((1 << 62) // width) // 2  # of a component, so that no squared distance passes 62 bits

    def block(batch: pa.RecordBatch, sums: np.ndarray, scans: list[int]):
        x = _integers(batch.column("v"), parts * width, scale)
        if len(x) and np.abs(x).max() > most:
            raise ValueError(f"components must not pass {most} after scaling")
        x = x.astype(np.int64)
        n = len(x)
        cut = x.reshape(n, parts, width)
        code, best = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
        upper, lower = np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
        if moves is not None:
            old = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, parts) for c in ("codes", "upper", "lower")]
        for p in range(parts):
            part, entries, scan = cut[:, p], books[p], np.arange(n)
            if moves is not None:
                code[:, p] = own = old[0][:, p].astype(np.int64)
                high, low = _above(old[1][:, p] + moves.own[p, own]), _below(old[2][:, p] - moves.others[p, own])
                free = np.maximum(low, moves.half[p, own])
                exact = np.arange(n) if final else np.flatnonzero(~(high < free))
                best[exact, p] = ((part[exact] - entries[own[exact]]) ** 2).sum(1)
                high[exact] = _above(np.sqrt(best[exact, p]))
                upper[:, p], lower[:, p] = high, low
                scan = np.flatnonzero(~(high < free))
            if len(scan):
                code[scan, p], best[scan, p], second = _assigned(part[scan], entries)
                upper[scan, p], lower[scan, p] = _above(np.sqrt(best[scan, p])), _below(np.sqrt(second)) if count > 1 else np.inf
                scans[0] += len(scan)
        if final:
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _lists(code, pa.int32()), pa.array(best.sum(1)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["vec_id", "label", "codes", "error", "slot", "total"])
        slot = code + np.arange(parts) * count
        np.add.at(sums[:, :width], slot.ravel(), cut.reshape(n * parts, width))
        sums[:, width] += np.bincount(slot.ravel(), minlength=parts * count)
        columns = [batch.column("vec_id"), batch.column("label"), _lists(x, pa.int64()), _lists(code, pa.int32()), _lists(upper, pa.float32()), _lists(lower, pa.float32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "codes", "upper", "lower", "slot", "total"])

    def run(batches):
        sums, scans, names, kinds = np.zeros((parts * count, width + 1), np.int64), [0], None, None
        for batch in small(batches, AT_ONCE):
            out = block(batch, sums, scans)
            names, kinds = out.schema.names, out.schema.types
            yield out
        if names:  # what this task adds: slots of sums and counts, and one for its scans
            total = np.concatenate((sums.ravel() if not final else sums.ravel()[:0], scans))
            slots = np.arange(len(total)) if not final else np.array([0])
            last = {"slot": pa.array(slots, pa.int64()), "total": pa.array(total.astype(np.int64), pa.int64())}
            yield pa.RecordBatch.from_arrays([last.get(c, pa.nulls(len(total), k)) for c, k in zip(names, kinds, strict=True)], names)

    return run


def _state(rows: DataFrame, final: bool) -> StructType:
    fields = "codes array<int>, error bigint" if final else "v array<bigint>, codes array<int>, upper array<float>, lower array<float>"
    own = StructType([StructField("vec_id", LongType()), rows.schema["label"]])
    return StructType([*own.fields, *StructType.fromDDL(fields).fields, StructField("slot", LongType()), StructField("total", LongType())])


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes:
    """The codes of vectors (vec_id, embedding, label) by codebooks that start as the parts of the first vectors and see so many rounds."""
    rows = whole_vectors(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        empty = rows.sparkSession.createDataFrame([], _state(rows, True)).drop("slot", "total")
        return Codes(empty, np.zeros((parts, 0, 0), np.int64), [])
    wide = {len(r["v"]) for r in first}
    if len(wide) > 1 or not (d := wide.pop()) or d % parts:
        raise ValueError(f"vectors must be of one width that {parts} divides")
    start = np.array([[math.floor(c * scale) for c in r["v"]] for r in first], np.int64)
    books = start.reshape(len(first), parts, d // parts).transpose(1, 0, 2).copy()
    state, moves, scanned = None, None, []
    for k in range(rounds + 1):
        final = k == rounds
        run = _passed(books, moves, scale if state is None else None, None, final)
        source = rows if state is None else state.where("slot is null").drop("slot", "total")
        now = stored(source.mapInArrow(run, _state(rows, final)), "vector-codes")
        # parts x entries x (width + 1) rows and one
        added = {r["slot"]: int(r["total"]) for r in now.where("slot is not null").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        if state is not None:
            done_with(state)
        state = now
        scanned.append(added[max(added)])
        if not final:
            shape = (parts, books.shape[1], d // parts + 1)
            total = [[[added[(p * shape[1] + e) * shape[2] + i] for i in range(shape[2])] for e in range(shape[1])] for p in range(parts)]
            new = [[[s // t[-1] for s in t[:-1]] if t[-1] else books[p, e].tolist() for e, t in enumerate(row)] for p, row in enumerate(total)]
            after = np.array(new, np.int64)
            moves, books = _Moves.of(books, after), after
    return Codes(state.where("slot is null").drop("slot", "total"), books, scanned)


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error summed over equal labels. A label that holds many rows is summed before the shuffle; its sum then goes to all tasks
    if there are few labels, else the rows of a label are spread over salted copies of it."""
    sums = stored(codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error")), "vector-labels")
    sums = sums.select(F.col("label").alias("_label"), "label_error")
    if sums.count() <= FEW_LABELS:
        return codes.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = codes.withColumn("_spread", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_spread") == F.col("_salt"))).drop("_label", "_salt", "_spread")


def restored(codes: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """codes with `restored`, the vectors that they stand for: the middle of each entry's integers, scaled back."""
    table = F.lit([[[(c + 0.5) / scale for c in e] for e in part] for part in books.tolist()])
    return codes.withColumn("restored", F.flatten(F.transform("codes", lambda c, p: table[p][c])))


def hexed(codes) -> F.Column:
    """An array of codes as two hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in DuckDB, without bounds: a step for each assignment and each update."""
    apart = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    steps = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: "
        f"CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL "
        "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"part AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS r(p))",
        f"c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM part WHERE rid <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT rid, p, any_value(x) AS x, min(({apart}) * {entries} + e) AS best FROM part JOIN c{k} USING (p) GROUP BY rid, p)")
        if k < rounds:
            steps += [
                f"s{k} AS (SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (SELECT p, best % {entries} AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL)",
                f"u{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{k} GROUP BY p, e)",
                f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(u{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN u{k} USING (p, e))",
            ]
    steps += [
        f"done AS (SELECT rid, string_agg(lpad(lower(to_hex(best % {entries})), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)",
        f"books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 "
        "FROM done JOIN kept USING (rid), books"
    )
