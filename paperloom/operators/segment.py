"""Pages to segments: gaps and islands, ordered texts, and the repair of segments that a model proposes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.rules import CATALOGUE, DocType
from .classify import classify


def islands(pages: DataFrame) -> DataFrame:
    """pages with seg_no from 1: a page goes on with the segment if its type is unknown or the segment's.

    The running segment's type is the last known one, so a new one begins where that changes. Windows are by document.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no")
    pages = pages.withColumn("_last", F.coalesce(F.last(F.nullif("page_type", F.lit("unknown")), ignorenulls=True).over(order), F.lit("unknown")))
    pages = pages.withColumn("_before", F.lag("_last").over(order))
    # unknown pages at the start belong to the segment of the first known one only if that is unknown too
    new = F.col("_before").isNull() | (F.col("_before") != F.col("_last"))
    return pages.withColumn("seg_no", F.sum(new.cast("int")).over(order)).withColumn("seg_type", F.col("_last")).drop("_last", "_before")


def ordered_text(text: str = "text", page: str = "page_no", mark: bool = False) -> Column:
    """The texts of a group in page order; with marks each page has a headline and no trailing space."""
    value = F.concat(F.lit("[PAGE "), F.col(page).cast("string"), F.lit("]\n"), F.rtrim(text)) if mark else F.col(text)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page, value.alias("t")))), lambda s: s["t"]), "\n")
    return joined if mark else F.regexp_replace(joined, r"(?U)^\s+|\s+$", "")


def segments(pages: DataFrame) -> DataFrame:
    """A row for each segment of classified pages with its range, text and confidence, and its headings if pages have them."""
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("page_no", c))), lambda s: s[c])
    heads = [F.flatten(in_order("headings")).alias("headings")] if "headings" in pages.columns else []
    return islands(pages).groupBy("doc_id", "seg_no").agg(
        F.max("seg_type").alias("seg_type"), F.min("page_no").alias("start_page"), F.max("page_no").alias("end_page"),
        F.max("page_confidence").alias("confidence"), ordered_text().alias("text"), *heads,
    )


def reclassified(found: DataFrame, catalogue: tuple[DocType, ...] = CATALOGUE) -> DataFrame:
    """Segments after a second look at their whole text: an unknown one takes the new type, a confirmed one the higher confidence."""
    again = classify(found, catalogue).withColumnsRenamed({"page_type": "whole_type", "page_confidence": "whole_confidence"})
    same = (F.col("seg_type") == "unknown") | (F.col("seg_type") == F.col("whole_type"))
    kind = F.when(F.col("seg_type") == "unknown", F.col("whole_type")).otherwise(F.col("seg_type"))
    sure = F.when(F.col("seg_type") == "unknown", F.col("whole_confidence")).when(same, F.greatest("confidence", "whole_confidence")).otherwise(F.col("confidence"))
    return again.withColumns({"document_type": kind, "keyword_confidence": sure}).drop("whole_type", "whole_confidence", "best2", "second2")


class _Strays:
    """Pages that no segment holds, as ranges in order, looked at from left to right."""

    def __init__(self):
        self.ranges: deque[tuple[int, int]] = deque()
        self.before = 0

    def add(self, low: int, high: int) -> None:
        if low <= high:
            self.ranges.append((low, high))

    def first_from(self, page: int) -> int | None:
        """The first one from a page on; `before` is then the last one before it, 0 if there is none."""
        while self.ranges and self.ranges[0][1] < page:
            self.before = self.ranges.popleft()[1]
        if not self.ranges:
            return None
        low, high = self.ranges[0]
        found = max(low, page)
        if found > low:
            self.before = found - 1
        return found


def _attached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of documents in order, without overlaps, with the pages that none holds attached: one by one, each to the segment whose start is nearest, the earlier one
    in doubt, which moves that start. So a segment starts at the first such page past the middle between its start and the new start of the one before,
    and the pages up to there are the other's. A row waits for the next one."""
    doc, start, last, pages, seg, waiting, strays = None, 0, 0, 0, 0, None, _Strays()

    def end() -> int:
        return max(last, strays.before if strays.before >= start else 0)

    def final() -> int:
        strays.add(last + 1, pages)
        strays.first_from(pages + 1)
        return end()

    for batch in batches:
        if not batch.num_rows:
            continue
        starts, numbers, ends = [], [], []
        for d, b, e, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start_page", "end_page", "_n")), strict=True):
            if seg and d == doc:
                strays.add(last + 1, b - 1)
                moved = strays.first_from((start + b) // 2 + 1)
                ends.append(end())
                seg, start = seg + 1, b if moved is None else moved
            else:
                if seg:
                    ends.append(final())
                seg, start, strays = 1, 1, _Strays()
                strays.add(1, b - 1)
            starts.append(start)
            numbers.append(seg)
            doc, last, pages = d, e, n
        made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int32()), pa.array(numbers, pa.int32())], [*batch.schema.names, "_start", "_seg"])
        if waiting is not None:
            made = pa.Table.from_batches([waiting, made]).combine_chunks().to_batches()[0]
        yield _with_ends(made.slice(0, len(ends)), ends)
        waiting = made.slice(len(ends))
    if waiting is not None:
        yield _with_ends(waiting, [final()])


def _with_ends(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c not in ("doc_id", "start_page", "end_page", "_n", "_start", "_seg")]
    columns = [batch.column("doc_id"), batch.column("_seg"), batch.column("_start"), pa.array(ends, pa.int32()), *(batch.column(c) for c in names)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "seg_no", "start_page", "end_page", *names])


def repaired(proposed: DataFrame, pages: DataFrame) -> DataFrame:
    """Proposed segments (doc_id, start_page, end_page, ...) clamped, without overlaps, and with no page left out.

    pages: doc_id, page_count. A segment starts after the furthest end of those before it, which is a running maximum; one that nothing is left of goes. Then one pass in order
    attaches the pages between. Both take time linear in a document's segments, whatever its pages.
    """
    rest = [c for c in proposed.columns if c not in ("doc_id", "start_page", "end_page")]
    order = Window.partitionBy("doc_id").orderBy("start_page", "end_page", *rest)
    x = proposed.join(pages.select("doc_id", F.col("page_count").cast("int").alias("_n")), "doc_id")
    start = F.greatest(F.lit(1), F.least("start_page", "_n"))
    x = x.withColumns({"_a": start, "_z": F.greatest(start, F.least("end_page", "_n")), "_order": F.row_number().over(order)})
    by_place = Window.partitionBy("doc_id").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_a", F.greatest("_a", F.coalesce(F.max("_z").over(by_place) + 1, F.col("_a")))).where("_a <= _z")
    x = x.select("doc_id", F.col("_a").cast("int").alias("start_page"), F.col("_z").cast("int").alias("end_page"), "_n", *rest, "_order")
    x = x.repartition("doc_id").sortWithinPartitions("doc_id", "_order").drop("_order")
    fields = "seg_no int, start_page int, end_page int"
    kinds = {f.name: f for f in x.schema}
    schema = StructType([kinds["doc_id"], *StructType.fromDDL(fields).fields, *(kinds[c] for c in rest)])
    return x.mapInArrow(_attached, schema)


def checked_ranges(ranges: DataFrame) -> DataFrame:
    """ranges (start_page, end_page) with n_pages. A range that starts before page 1 or ends before it starts is an error when rows are read."""
    good = (F.col("start_page") >= 1) & (F.col("end_page") >= F.col("start_page"))
    wrong = F.concat(F.lit("invalid page range "), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"))
    return ranges.withColumn("n_pages", F.when(good, F.col("end_page") - F.col("start_page") + 1).otherwise(F.raise_error(wrong).cast("int")))


def looked_up(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages that wanted (doc_id, page_no) names. One that is missing is an error when rows are read."""
    found = wanted.join(pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text")), ["doc_id", "page_no"], "left")
    missing = F.concat(F.lit("no page "), F.col("page_no").cast("string"), F.lit(" in "), F.col("doc_id").cast("string"))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(missing).cast("string")))


def headings(lines: DataFrame, most: int = 6) -> DataFrame:
    """Headings of each page from (doc_id, page_no, line_no, font_size, text).

    The body size is that of most characters, the first seen among equals; a heading is at least 1.15 times as large.
    """
    by_size = lines.groupBy("doc_id", "page_no", "font_size").agg(F.sum(F.length("text")).alias("n"), F.min("line_no").alias("first"))
    body = by_size.groupBy("doc_id", "page_no").agg(F.max_by("font_size", F.struct("n", -F.col("first"))).alias("body_size"))
    size = F.length("text")
    large = lines.join(body, ["doc_id", "page_no"]).where((F.col("font_size") >= 1.15 * F.col("body_size")) & (size > 2) & (size <= 80))
    listed = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]))
    return large.groupBy("doc_id", "page_no").agg(F.first("body_size").alias("body_size"), F.slice(listed, 1, most).alias("headings"))
