"""Operator 5: secrets, found through an incremental ledger of blobs; DataFrame functions only.

Every version of a text is a blob, addressed by its SHA-256. The ledger holds what each rule version found in each
blob, nothing included. A scan hashes all paths, takes one copy of each blob for which some rule version is
missing, runs just the missing rules on it, appends the findings to the ledger, and joins the ledger back to
all paths. Changing a rule means a new version: only that rule runs again, and unchanged blobs never run twice.

Results in special cases. Null text: counts as empty, no findings; `redact` leaves it null. Empty table: no rows. Very long texts: whole. Repeated
rows share a blob and have equal findings, also where the ledger holds a blob and rule more than once. Rows with equal or null doc_ids
are each a path. Ties: spans sort by start, then by the order of the rules. Extra columns, also of names used here, are kept by
`redact` and ignored by `secrets`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keeps_columns, kind_spans, match_spans, scratch_path, span_list, whole_text

_NAME = "(?i:password|passwd|secret|token|api_?key)"
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"


@dataclass(frozen=True)
class Rule:
    """keep: which matches count; hint: a cheap test that texts with a match pass."""

    kind: str
    version: int
    pattern: str
    keep: Callable[[Column], Column] | None = None
    hint: Callable[[Column], Column] | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _has(*parts: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        out = F.contains(text, F.lit(parts[0]))
        for p in parts[1:]:
            out = out | F.contains(text, F.lit(p))
        return out

    return test


#: In this order at equal starts. The last two are added by this operator.
RULES = (
    Rule("assign", 1, _NAME + _SIGN + _VALUE, lambda m: F.length(F.regexp_extract(m, f"^{_NAME}{_SIGN}({_VALUE})", 1)) >= 6, _has("=", ":")),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", None, _has("AKIA")),
    Rule("hex", 1, "(?<![0-9a-f])[0-9a-f]{24,}", None, lambda t: t.rlike("[0-9a-f]{24}")),
    Rule("pem", 1, "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", None, _has("-----BEGIN ")),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", None, _has("eyJ")),
)
BASE = ("assign", "access", "hex")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger (a folder that driver and executors share) up to date and return it for `rules`.

    Ledger rows: blob, rule (kind@version), spans.
    """
    spark = docs.sparkSession
    keys = [r.key for r in rules]
    text = whole_text()
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    schema = "blob string, rule string, spans array<struct<start:bigint,kind_no:int,kind:string,end:bigint,value:string>>"
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        seen = spark.read.schema(schema).parquet(ledger).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("seen", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", F.array(*map(F.lit, keys)))
    text = F.col("text")
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint,value:string>>")
    findings = []
    for n, r in enumerate(rules):
        wanted = F.array_contains("todo", r.key)
        worth = r.hint(text) if r.hint else F.lit(True)
        spans = F.when(wanted & worth, kind_spans(match_spans(text, r.pattern, r.keep), r.kind, n))
        findings.append(F.struct(F.lit(r.key).alias("rule"), F.coalesce(spans, empty).alias("spans")))
    rows = blobs.select("blob", "todo", F.inline(F.array(*findings))).where(F.array_contains("todo", F.col("rule"))).drop("todo")
    rows.write.mode("append").parquet(ledger)
    return spark.read.schema(schema).parquet(ledger).where(F.col("rule").isin(keys))


def find_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (without its text unless it is asked for by name) is joined to its findings: column _found.

    Without a ledger a new one is kept in the shared scratch folder.
    """
    found = scan(docs, ledger or scratch_path(docs.sparkSession, "ledger"), rules)
    # a set, as scans at once or an append that ran twice leave equal rows of a blob and rule
    spans = found.where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("_found"))
    paths = docs.drop("_found", "_blob").withColumn("_blob", F.sha2(whole_text(), 256))
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint,value:string>>")
    joined = paths.join(spans.withColumnRenamed("blob", "_blob"), "_blob", "left")
    return joined.withColumn("_found", F.coalesce("_found", empty))


def secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, a count for each base kind, a digest of the base spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"), ledger).select("doc_id", "_found")
    count = lambda k: F.size(F.filter("_found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("_found", lambda s: s["kind_no"] < len(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("_found")).alias("spans"))


@keeps_columns
def redact(docs: DataFrame, ledger: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with each maximal stretch of secrets in a text replaced by `mask`, and n_chars to match."""
    found = find_secrets(docs, ledger)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    grow = lambda a, s: F.when(
        (F.size(a) > 0) & (s["start"] < last(a)["end"]),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    found = found.withColumn("_cut", F.aggregate("_found", none, grow))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("_cut", i)["end"].cast("int"))
    until = lambda i: F.coalesce(F.try_element_at("_cut", i + 1)["start"].cast("int"), F.length("text"))
    parts = F.transform(F.sequence(F.lit(0), F.size("_cut")), lambda i: F.substr(F.col("text"), before(i) + 1, until(i) - before(i)))
    text = F.when(F.size("_cut") == 0, F.col("text")).otherwise(F.array_join(parts, mask))
    changed = F.size("_cut") > 0
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
