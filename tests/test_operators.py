"""Single operators on small rows, with edges and properties."""

import random
import time
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.functions import dates, keywords, mrz, rules
from paperloom.functions import text as T
from paperloom.functions.rules import CATALOGUE, LANGUAGES, Settings
from paperloom.operators import classify, naming, segment
from paperloom.plans import analyse, demo
from paperloom.sources import readers, sinks
from paperloom.streaming.ingest import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_catalogue_is_whole():
    assert len(CATALOGUE) == 23 and sum(len(t.keywords) for t in CATALOGUE) == 174
    assert len(rules.LABEL_WORDS) == 66 and len(rules.NOT_A_PERSON) == 67 and len(rules.RELATIONSHIPS) == 23


@pytest.mark.parametrize(
    ("score", "second", "expected"),
    [(None, None, 0.1), (1, 0, 0.22), (4, 0, 0.28), (5, 0, 0.362), (13, 0, 0.463), (13, 11, 0.363), (19, 0, 0.537), (20, 0, 0.55), (24, 24, 0.5), (40, 0, 0.55)],
)
def test_confidence(spark, score, second, expected):
    c = classify.confidence(F.lit(score).cast("int"), F.lit(second).cast("int"))
    assert one(spark, c) == pytest.approx(expected)


def test_scores_count_twice_at_most_and_break_ties_by_rank(spark):
    found = one(spark, classify.scores(F.lit("Anabin  ANABIN anabin"), CATALOGUE))
    assert [(s.type_key, s.score2) for s in found] == [("02.1_anabin_uni", 12), ("02.2_anabin_degree", 12)]
    assert one(spark, classify.scores(F.lit(None).cast("string"))) == []


def plain_scores(text, catalogue):
    hay = " ".join((text or "").lower().split())
    found = [(sum(min(hay.count(w), 2) * k for w, k in t.keywords), -n, t.key) for n, t in enumerate(catalogue)]
    return sorted((x for x in found if x[0] > 0), reverse=True)


@pytest.mark.parametrize("n", [3, 40, 5000])
def test_keywords_in_one_pass_equal_single_searches(spark, n):
    """Beginnings of each other, overlaps with themselves and each other, characters that patterns treat specially; thousands of them."""
    rnd = random.Random(n)
    letters = "ab" if n < 1000 else "abcdefgh"
    word = lambda: "".join(rnd.choice(letters + " +(.é") for _ in range(rnd.randint(1, 8))).strip() or "a"
    words = [" ".join(word().split()) for _ in range(n)]
    catalogue = tuple(rules.DocType(f"t{k}", "", tuple((w, rnd.randint(0, 5)) for w in words[k::7])) for k in range(min(7, n)))
    texts = [None, "", "aaaa", "ABAB  aba\taba"] + [" ".join(rnd.choice([word(), rnd.choice(words)]) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [tuple(x) for x in r.s] for r in frame.select("i", classify.scores(F.col("text"), catalogue).alias("s")).collect()}
    assert got == {i: plain_scores(t, catalogue) for i, t in enumerate(texts)}


def test_a_catalogue_from_a_table(spark):
    rows = [(2, "b", "Dog", 3), (1, "a", "cat", 2), (1, "a", "cat", 4), (2, "b", None, 1), (None, "x", "y", 1), (2, "b", "", 1), (1, "a", "bird", None)]
    catalogue = keywords.catalogue_of(spark.createDataFrame(rows, "type_no int, type_key string, keyword string, weight2 int"))
    assert [(t.key, t.keywords) for t in catalogue] == [("a", (("bird", 0), ("cat", 4))), ("b", (("dog", 3),))]
    assert keywords.catalogue_of(spark.createDataFrame([], "type_no int, type_key string, keyword string, weight2 int")) == ()
    assert one(spark, classify.scores(F.lit("cat"), ())) == []


def test_scores_by_a_table_of_any_size(spark, monkeypatch):
    """Joined with a table of more rules than a catalogue may have; repeated rules count each time, keywords overlap, texts are cut into pieces."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcé ") for _ in range(rnd.randint(1, 6))).strip() or "a"
    rows = [(f"t{rnd.randint(0, 6)}", word(), rnd.randint(1, 5)) for _ in range(300)] + [("t1", "aa", 2), ("t1", "aa", 2), ("t2", None, 1), ("t2", "", 1)]
    texts = [None, "", "aaa", "aaaa"] + [" ".join(rnd.choice([word(), rnd.choice(rows[:300])[1]]) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    plain = {}
    for i, t in enumerate(texts):
        for kind, w, weight in rows:
            if w and (n := min((t or "").count(w), 2)):
                plain[i, kind] = plain.get((i, kind), 0) + n * weight
    monkeypatch.setattr(keywords, "MOST_RULES", 10)
    hays = spark.createDataFrame(list(enumerate(texts)), "i int, hay string")
    got = keywords.table_scores(hays, spark.createDataFrame(rows, "type_key string, keyword string, weight2 int"))
    assert {(r.i, r.type_key): r.score2 for r in got.collect()} == plain
    assert keywords.table_scores(hays, spark.createDataFrame([], "type_key string, keyword string, weight2 int")).count() == 0

    monkeypatch.setattr(keywords, "AT_ONCE", 16)
    every = keywords._occurrences(SimpleNamespace(value=b"\xff" * 4096), 15, list(range(1, 13)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["i", "hay"])
    found = {(r["i"], r["keyword"]): r["times"] for out in every([batch]) for r in out.to_pylist()}
    words = {w for _, w, _ in rows if w}
    assert {k: n for k, n in found.items() if k[1] in words} == {(i, w): min(t.count(w), 2) for i, t in enumerate(texts) if t for w in words if w in t}


def test_islands(spark):
    def run(types):
        rows = [("d", n, t) for n, t in enumerate(types, 1)]
        x = segment.islands(spark.createDataFrame(rows, "doc_id string, page_no int, page_type string")).orderBy("page_no").collect()
        return [r.seg_no for r in x]

    kinds = {"u": "unknown"}
    assert run([kinds.get(c, c) for c in "uuauabu"]) == [1, 1, 2, 2, 2, 3, 3]
    assert run(["unknown"] * 3) == [1, 1, 1]
    rnd = random.Random(1)
    for _ in range(5):
        types = [rnd.choice(["unknown", "a", "b"]) for _ in range(30)]
        running, n, expected = None, 0, []
        for t in types:
            if running is None or not (t == "unknown" or t == running):
                running, n = t, n + 1
            expected.append(n)
        assert run(types) == expected


def test_check_digits_equal_a_loop(spark):
    values = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rnd = random.Random(2)
    rows = [("".join(rnd.choice(values + "<") for _ in range(rnd.randint(0, 40))),) for _ in range(200)]
    for r in spark.createDataFrame(rows, "s string").select("s", mrz.check_digit(F.col("s")).alias("d")).collect():
        assert r.d == sum(max(values.find(c), 0) * (7, 3, 1)[i % 3] for i, c in enumerate(r.s)) % 10


def test_dates_round_trip(spark):
    x = spark.range(3000).select(F.date_add(F.lit("1971-01-01").cast("date"), (F.col("id") * 11).cast("int")).alias("d"))
    x = x.select("d", dates.parse_date(dates.show_date(F.col("d"))).alias("p"))
    assert x.where("p is null or p <> d").count() == 0


def test_label_words_are_dropped(spark):
    assert one(spark, T.drop_label_words(F.lit("SMITH Given names:"))) == "SMITH"
    assert one(spark, T.drop_label_words(F.lit("date of"))) == "date of"
    assert one(spark, T.drop_label_words(F.lit("Name Date"))) is None
    assert one(spark, T.normalise_title(F.lit("TERMS OF THE LEASE"))) == "Terms of the Lease"
    assert one(spark, T.normalise_title(F.lit("cover LETTER"))) == "Cover Letter"


def test_numbered_names_are_unique(spark):
    rows = [("a", n, i) for i, n in enumerate(["x.pdf", "x.pdf", "x (2).pdf", "x.pdf", "y.pdf", "x (2).pdf"])] + [("b", "x.pdf", 9)]
    found = naming.numbered(spark.createDataFrame(rows, "folder string, name string, k int"), "folder", "name", "k").collect()
    assert len({(r.folder, r.unique_name) for r in found}) == len(rows)
    assert {r.k: r.unique_name for r in found}[0] == "x.pdf"


def test_repaired_segments_cover_each_page_once(spark):
    rnd = random.Random(3)
    rows, counts = [], []
    for d in range(40):
        n = rnd.randint(1, 8)
        counts.append((d, n))
        for _ in range(rnd.randint(1, 5)):
            a = rnd.randint(1, 9)
            rows.append((d, a, a + rnd.randint(0, 3)))
    found = segment.repaired(spark.createDataFrame(rows, "doc_id int, start_page int, end_page int"), spark.createDataFrame(counts, "doc_id int, page_count int")).collect()
    for d, n in counts:
        pages = {p for r in found if r.doc_id == d for p in range(r.start_page, r.end_page + 1)}
        assert pages == set(range(1, n + 1))


def folded(segs, n):
    """Segments repaired one by one, and pages that none holds attached one by one."""
    out = []
    for a, z, v in sorted(segs):
        a = max(1, min(a, n))
        z = max(a, min(z, n))
        if out and a <= out[-1][1]:
            a = out[-1][1] + 1
        if a <= z:
            out.append([a, z, v])
    for p in [p for p in range(1, n + 1) if not any(a <= p <= z for a, z, _ in out)]:
        near = min(out, key=lambda s: abs(s[0] - p))
        near[0], near[1] = min(near[0], p), max(near[1], p)
    return [tuple(s) for s in out]


def test_repairs_equal_a_fold(spark):
    rnd = random.Random(9)
    docs = {}
    for d in range(150):
        n = rnd.randint(1, 60)
        docs[d] = (n, [(a, a + rnd.randint(-1, 5), rnd.choice("xyz")) for a in (rnd.randint(-1, n + 2) for _ in range(rnd.randint(1, 9)))])
    rows = [(d, a, z, v) for d, (_, segs) in docs.items() for a, z, v in segs]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id int, start_page int, end_page int, v string").repartition(4)
    got = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = segment.repaired(frame, spark.createDataFrame([(d, n) for d, (n, _) in docs.items()], "doc_id int, page_count int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in sorted(found, key=lambda r: (r.doc_id, r.seg_no)):
        got.setdefault(r.doc_id, []).append((r.start_page, r.end_page, r.v))
        assert r.seg_no == len(got[r.doc_id])
    assert got == {d: folded(segs, n) for d, (n, segs) in docs.items()}


def test_a_document_of_many_pages_is_repaired_fast(spark):
    n = 100_000
    rows = spark.range(40_000).select(F.lit("d").alias("doc_id"), (F.col("id") * 5 % n).cast("int").alias("start_page"), (F.col("id") * 5 % n + F.col("id") % 7).cast("int").alias("end_page"))
    began = time.perf_counter()
    found = segment.repaired(rows, spark.createDataFrame([("d", n)], "doc_id string, page_count int")).agg(F.min("start_page").alias("a"), F.max("end_page").alias("z"), F.count("*").alias("k")).first()
    assert found.a == 1 and found.z == n and found.k > 10_000 and time.perf_counter() - began < 30


def test_dates_after_hints_equal_windows(spark):
    """Also where a window's end cuts a date or the digits of something longer, and where one stands before a hint."""
    rnd = random.Random(12)
    bits = ["valid until", "expires", "12.03.2026", "1.2.27", "2031-05-06", "12 expires 2026", "99.99.2020", "31/12/1999", "15 May 2030", "123.456", "12.03.20266", "x", ",", "gültig bis", "\n", "7.8.2029a"]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(150)]
    texts += ["expires" + " " * (k + 90) + "12.03.2026 and 4.5.2028" for k in range(30)] + ["valid until " + "y" * (100 + k) + " 12.03.20266" for k in range(12)] + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    # each hint's window read by itself
    hint = lambda h: F.when(F.instr(F.lower("text"), h) > 0, F.try_element_at(dates.find_dates(F.substr("text", F.instr(F.lower("text"), h), F.lit(120))), F.lit(1)))
    plain = F.coalesce(*(hint(h) for h in rules.EXPIRY_HINTS))
    late = F.array_max(F.filter(dates.find_dates(F.col("text")), lambda d: F.year(d) >= 2000))
    out = frame.select("i", dates.find_expiry(F.col("text")).alias("x"), dates.show_date(F.coalesce(plain, late)).alias("value"), F.when(plain.isNotNull(), "label").when(late.isNotNull(), "guessed").alias("kind")).collect()
    assert [(r.i, r.x.value, r.x.kind) for r in out] == [(r.i, r.value, r.kind) for r in out]
    assert {r.kind for r in out} == {"label", "guessed", None}


def test_demo_documents(spark):
    pages = demo.pages(spark)
    batches = pages.select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("batch_id"), F.lit(1).alias("upload_no"))
    found = {(r.doc_id, r.start_page): r for r in analyse.analysed(pages, batches, Settings()).collect()}
    assert {k: (r.document_type, r.confidence, r.status) for k, r in found.items()} == {
        ("a_bundle", 1): ("01_passport", 0.95, "READY"), ("a_bundle", 3): ("15_visa", 0.92, "READY"), ("a_bundle", 4): ("09_marriage_certificate", 0.537, "REVIEW REQUIRED"),
        ("b_payslip", 1): ("12_payslip", 0.92, "READY"), ("c_birth", 1): ("10_birth_certificate", 0.412, "REVIEW REQUIRED"), ("d_cv", 1): ("03_cv", 0.92, "READY"),
        ("e_other", 1): ("other", 0.92, "READY"), ("f_blank", 1): ("unknown", 0.1, "REVIEW REQUIRED"), ("g_broken", 1): ("01_passport", 0.55, "REVIEW REQUIRED"),
    }
    assert found["a_bundle", 1].unique_name == "01_passport_valid 22.05.2031_Brook_Ada_Lumen Optik.pdf"
    assert found["c_birth", 1].unique_name == "10_birth certificate_child 1_Nora_Brook_Theo_UNKNOWN.pdf"
    assert found["e_other", 1].unique_name == "MB Business Contact_Brook_Ada_Lumen Optik GmbH.pdf"


def test_files_are_read_and_bad_ones_stand_apart(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("first page\fsecond page")
    (tmp_path / "b.pdf").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "c.pdf").write_bytes(b"x" * 2_000_000)
    found = readers.files(spark, str(tmp_path))
    pages = readers.read_pages(found, readers.PlainTextReader(), Settings(max_upload_mb=1))

    class Engine:
        name = "engine"

        def text(self, doc_id, page_no):
            return "read again" if page_no == 2 else None

    filled = {(r.doc_id[-5:], r.page_no): r for r in readers.fill_by_ocr(pages, Engine(), Settings()).collect()}
    assert filled["a.pdf", 1].text == "first page" and filled["a.pdf", 2].text == "read again" and filled["a.pdf", 2].source == "engine"
    assert "UnicodeDecodeError" in filled["b.pdf", None].error and "larger than the 1 MB" in filled["c.pdf", None].error


def test_manifest_is_written_by_client(spark, tmp_path):
    pages = demo.pages(spark).where("doc_id in ('b_payslip', 'f_blank')")
    batches = pages.select("doc_id").distinct().select("doc_id", F.lit(1).alias("batch_id"), F.col("doc_id").alias("upload_no"))
    manifest = analyse.analysed(pages, batches, Settings()).select("status", "client_key", "target_dir", "unique_name")
    sinks.write(manifest, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.status, r.client_key) for r in back.collect()} == {("READY", "Brook_Ada"), ("REVIEW REQUIRED", "UNKNOWN_UNKNOWN")}
    assert sinks.archive_manifest(back).first()["entry"].startswith("Brook_Ada/12_payslip_2026-03")


def test_stream_of_pages(spark, tmp_path):
    demo.pages(spark).where("doc_id = 'b_payslip'").write.json(str(tmp_path / "in"))
    pages = spark.readStream.schema("doc_id string, page_no int, text string, headings array<string>").json(str(tmp_path / "in"))
    ingest(pages, str(tmp_path / "out"), str(tmp_path / "at"), Settings()).awaitTermination(120)
    assert [r.document_type for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["12_payslip"]


def test_small_catalogues(spark):
    assert one(spark, classify.scores(F.lit("the cat and the dog"), LANGUAGES))[0]["type_key"] == "en"
