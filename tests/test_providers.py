"""Model and OCR providers, names next to stored ones, and checks that fail."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions.order import ranked, settled
from paperloom.functions.rules import Settings
from paperloom.operators import extract, naming, score, segment
from paperloom.plans import analyse, demo
from paperloom.sources import models, readers, sinks

S = Settings()
MIXED = [
    ("m", 1, "PASSPORT\nPassport No: K7M20319Q\nDate of expiry: 22.05.2031\n" + demo.MRZ, []), ("m", 2, "some words without a keyword that stand apart", []),
    ("n", 1, "nothing", []), ("o", 1, " ", []),
]
WHOLE = '{"documents": [{"document_type": "03_cv", "start_page": 2, "end_page": 1, "first_name": "Eve", "last_name": "Wrong", "company": "Lumen", "confidence": 0.6}]}'


def ruled(spark, rows):
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string, headings array<string>")
    return settled(score.score(extract.extract(analyse.segmented(pages), S), S)), pages


def test_whole_documents_go_to_the_model_where_a_segment_is_unknown(spark):
    rows = [("m", 1, "zzz", []), *((d, n + 1 if d == "m" else n, t, h) for d, n, t, h in MIXED)]
    found, pages = ruled(spark, rows)
    model = models.TableModel({"K7M20319Q": WHOLE, "nothing": "no idea"}, {"K7M20319Q": 2})
    out = {r.doc_id: r for r in models.with_model(found, pages, model, S, wait=models.no_wait).collect()}
    assert (out["m"].start_page, out["m"].end_page) == (1, 3)  # turned round, and the page left out attached
    # what check digits verified stays over the model's answer, and evidence is united
    assert (out["m"].document_type, out["m"].last_name, out["m"].first_name, out["m"].company, out["m"].source) == ("01_passport", "Brook", "Ada", "Lumen", "model")
    assert out["m"].confidence == 0.88 and any(e.kind == "verified" for e in out["m"].evidence)
    assert out["n"].source == "rules" and out["o"].source == "rules"
    assert models.with_model(found, pages, models.NoModel(), S) is found


def test_calls_are_tried_again_with_longer_waits(spark, tmp_path):
    path = str(tmp_path / "waits")

    def wait(seconds):
        with open(path, "a") as f:
            f.write(f"{seconds} ")

    rows = spark.createDataFrame([(1, "good one"), (2, "bad one")], "id int, question string").coalesce(1)
    out = {r.id: r for r in models.ask(rows, models.TableModel({"good": "{}", "bad": "{}"}, {"good": 2, "bad": 9}), "", 5, wait).collect()}
    assert out[1].answer == "{}" and out[1].failure is None
    assert out[2].answer is None and out[2].failure == "table request failed: ConnectionError: call 5 failed"
    assert open(path).read().split() == ["2", "4", "2", "4", "8", "8"]


def test_model_choice():
    class Down(models.TableModel):
        def available(self):
            return False

    up, down = models.TableModel({}), Down({})
    assert models.choose("auto", up, None) is up and models.choose("auto", down, up) is up and models.choose("cloud", up, down).name == "rules only"
    assert models.choose("none", up, up).name == "rules only" and models.choose("local", up, None) is up


def test_prompt():
    block = models.catalogue_block()
    assert block.split("\n")[0] == '- "01_passport": Passport [needs valid_until]' and len(block.split("\n")) == 23
    assert '- "12_payslip": Payslip [needs period (YYYY-MM)]' in models.system_prompt("A\n{{DOCUMENT_TYPES}}\nB")


def test_ocr_chain(spark):
    rows = [(d, n, t, "text", [], None) for d, n, t in [("a", 1, "x" * 80), ("a", 2, ""), ("a", 3, " "), ("b", 1, ""), ("c", 1, "short"), ("e", 1, "")]]
    rows += [("d", None, None, "empty", [], "unreadable")]
    pages = spark.createDataFrame(rows, readers.PAGES).repartition(3)

    class Pagewise:
        name = "pagewise"

        def text(self, doc_id, page_no):
            if doc_id == "e":
                raise OSError("down")
            return f" {doc_id}{page_no} " if doc_id != "c" else "  "

    layout = readers.LayoutOcr(lambda d: {"a": [{"page": 2, "lines": ["one", "two"], "words": ["x"]}, {"page": 3, "words": [], "content": ""}], "b": [{"page": 1, "content": " "}]}.get(d, []))
    out = {(r.doc_id, r.page_no): (r.text, r.source) for r in readers.fill_by_ocr(pages, Pagewise(), S, layout).collect()}
    # a whole-file answer counts if it fills any page; then its empty pages stay empty
    assert out["a", 2] == ("one\ntwo", "layout") and out["a", 3] == (" ", "text") and out["b", 1] == ("b1", "pagewise")
    assert out["c", 1] == ("short", "text") and out["e", 1] == ("", "text") and out["d", None] == (None, "empty") and out["a", 1][0] == "x" * 80
    out = {(r.doc_id, r.page_no): r.text for r in readers.fill_by_ocr(pages, Pagewise(), S).collect()}
    assert out["a", 2] == "a2" and len(out) == 7


def test_names_equal_a_loop(spark):
    r = random.Random(4)
    pick = lambda: r.choice(["x", "y"]) + r.choice(["", "", "", " (2)", " (3)", " (2) (2)", " (11)", " (03)"]) + r.choice([".pdf", ""])
    rows = [(n, r.choice("AB"), pick()) for n in range(300)]
    stored = list({(r.choice("AC"), pick()) for _ in range(6)})
    for there in ([], stored):
        taken, want = set(there), {}
        for n, folder, name in rows:
            stem, dot, end = name.rpartition(".")
            stem, end = (stem, dot + end) if dot else (name, "")
            k, free = 1, name
            while (folder, free) in taken:
                k += 1
                free = f"{stem} ({k}){end}"
            taken.add((folder, free))
            want[n] = free
        frame = spark.createDataFrame(rows, "n int, folder string, name string").repartition(4)
        old = spark.createDataFrame(there, "folder string, name string") if there else None
        assert {x.n: x.unique_name for x in naming.numbered(frame, "folder", "name", "n", old).collect()} == want


def test_plain_names_of_a_mixed_family_are_spread(spark, monkeypatch):
    """A third of all rows has one name, in a folder with stored and numbered ones: their numbers come from range sorts, not from one task."""
    rows = spark.range(6000).select(F.col("id").cast("int").alias("n"), F.lit("A").alias("folder"), F.when(F.col("id") % 3 == 0, "hot.pdf").when(F.col("id") % 500 == 1, F.concat(F.lit("hot ("), (F.col("id") % 37 * 50 + 2).cast("string"), F.lit(").pdf"))).otherwise(F.concat("id", F.lit(".pdf"))).alias("name"))
    there = spark.createDataFrame([("A", f"hot ({k}).pdf") for k in (2, 3, 700)] + [("A", "hot.pdf")], "folder string, name string")
    taken, want = {("A", r.name) for r in there.collect()}, {}
    low = {}
    for r in rows.orderBy("n").collect():
        stem, free, k = r.name[:-4], r.name, low.get(r.name, 1)
        while ("A", free) in taken:
            k += 1
            free = f"{stem} ({k}).pdf"
        low[r.name] = k
        taken.add(("A", free))
        want[r.n] = free
    passed = spark.sparkContext.accumulator(0)
    settle = naming._settle_claims

    def counted(batches):
        def each():
            for b in batches:
                passed.add(len(b))
                yield b

        yield from settle(each())

    monkeypatch.setattr(naming, "_settle_claims", counted)
    assert {r.n: r.unique_name for r in naming.numbered(rows, "folder", "name", "n", there).collect()} == want
    assert 10 < passed.value < 60  # only names that look numbered, each once


def test_exports_never_overwrite(spark, tmp_path):
    folder = str(tmp_path / "filed")
    none = F.lit(None).cast("string")
    x = spark.range(3).select("id", F.lit("03_cv").alias("document_type"), F.lit("Brook").alias("last_name"), F.lit("Ada").alias("first_name"), F.lit("Lumen").alias("company"), F.col("id").alias("doc_ordinal"), (F.col("id") == 2).alias("requires_review"), none.alias("error"))
    x = x.withColumns({c: none for c in ("valid_until", "city", "period", "title", "relationship", "dependent_name")} | {"child_index": F.lit(None).cast("int"), "status": F.lit("READY")})
    assert sinks.stored_names(spark, folder) is None
    for _ in range(2):
        sinks.write(sinks.export_manifest(x, S, sinks.stored_names(spark, folder), review_by_client=False), folder)
    names = [(r.folder, r.name) for r in sinks.stored_names(spark, folder).collect()]
    assert len(set(names)) == 6 and ("review", "03_CV_Brook_Ada_Lumen (2).pdf") in names and ("Clients/Brook_Ada", "03_CV_Brook_Ada_Lumen (4).pdf") in names


def test_empty_archives_and_wrong_ranges_are_errors(spark):
    filed = spark.createDataFrame([("Clients/a", "a", "x.pdf"), ("review/b", "b", "y.pdf")], "target_dir string, client_key string, unique_name string")
    assert [r.entry for r in sinks.archive_manifest(filed).collect()] == ["a/x.pdf"] and [r.entry for r in sinks.archive_manifest(filed, "a").collect()] == ["x.pdf"]
    for client in ("b", "nobody"):
        with pytest.raises(Exception, match=f"No documents to export for {client}"):
            sinks.archive_manifest(filed, client).collect()
    with pytest.raises(Exception, match="There are no processed documents"):
        sinks.archive_manifest(filed.where("false")).collect()
    assert sinks.archive_name("a") == sinks.archive_name("a.zip") == "a.zip"
    ranges = lambda a, b: segment.checked_ranges(spark.createDataFrame([(a, b)], "start_page int, end_page int"))
    assert ranges(2, 4).first().n_pages == 3
    for a, b in ((0, 2), (3, 2)):
        with pytest.raises(Exception, match=f"invalid page range {a}-{b}"):
            ranges(a, b).collect()
    pages = spark.createDataFrame([("a", 1, None)], "doc_id string, page_no int, text string")
    with pytest.raises(Exception, match="no page 2 in a"):
        segment.looked_up(spark.createDataFrame([("a", 2)], "doc_id string, page_no int"), pages).collect()


def test_spellings_that_tidying_makes_one_are_one_company(spark):
    rows = [("a", 1, "Lumen  Optik GmbH", None), ("b", 2, " Lumen Optik GmbH,", None), ("c", 3, None, None), ("d", 4, "Other AG", "failed")]
    none = F.lit(None).cast("string")
    x = spark.createDataFrame(rows, "doc_id string, doc_ordinal int, company string, error string")
    x = x.withColumns({"last_name": F.when(F.col("doc_id") == "c", "Brook"), "first_name": F.when(F.col("doc_id") == "c", "Ada"), "batch_id": F.lit(1), "document_type": F.lit("03_cv"), "text": F.lit(""), "headings": F.array(F.lit(""))})
    x = x.withColumns({c: none for c in ("valid_until", "city", "period", "title", "relationship", "dependent_name")} | {"child_index": F.lit(None).cast("int"), "keyword_confidence": F.lit(0.5), "confidence": F.lit(0.5), "source": F.lit("rules")})
    x = x.withColumn("evidence", F.array(*(F.struct(F.lit(f).alias("field"), F.lit("label").alias("kind")) for f in ("last_name", "first_name"))))
    out = {r.doc_id: r for r in analyse.finished(x, S).collect()}
    assert out["c"].company == "Lumen Optik GmbH" and out["c"].confidence == 0.92 and "d" not in out


def test_long_names_are_cut(spark):
    none = F.lit(None).cast("string")
    x = spark.range(1).select(F.lit("03_cv").alias("document_type"), F.lit("Brook").alias("last_name"), F.lit("Ada").alias("first_name"), F.concat(F.lit("y" * 156 + " . "), F.lit("z" * 60)).alias("company"))
    x = x.withColumns({c: none for c in ("valid_until", "city", "period", "title", "relationship", "dependent_name")} | {"child_index": F.lit(None).cast("int")})
    name = x.select(naming.file_name(S).alias("n")).first().n
    whole = "03_CV_Brook_Ada_" + "y" * 156 + " . " + "z" * 60 + ".pdf"
    assert name == re.sub("[ _.]+$", "", whole[:176]) + ".pdf" and len(name) <= 180


def test_a_zone_counts_for_every_type_and_a_child_needs_a_name(spark):
    rows = [("v", 1, "VISA visum, number of entries: one\n" + demo.MRZ, []), ("b", 1, "Geburtsurkunde\nStandesamt Bremen\nFather: Theo Brook", []), ("p", 1, "power of attorney vollmacht child kind minor", [])]
    out = {r.doc_id: r for r in ruled(spark, rows)[0].collect()}
    assert (out["v"].document_type, out["v"].last_name, out["v"].first_name, out["v"].valid_until) == ("15_visa", "Brook", "Ada", "22.05.2031")
    assert out["b"].relationship is None and out["b"].child_index is None and out["p"].relationship == "child"


@pytest.mark.parametrize("keys", [["k"], [], ["k", "j"]])
def test_ranks_equal_a_window(spark, keys):
    r = random.Random(8)
    rows = [(n, r.choice(["hot"] * 8 + ["a", None]), r.choice([1, None])) for n in range(500)]
    r.shuffle(rows)
    out = ranked(spark.createDataFrame(rows, "n int, k string, j int").repartition(6), keys, ["n"], "rank").collect()
    seen, want = {}, {}
    for n, k, j in sorted(rows):
        key = tuple({"k": k, "j": j}[c] for c in keys)
        seen[key] = want[n] = seen.get(key, 0) + 1
    assert {x.n: x["rank"] for x in out} == want
