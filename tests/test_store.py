"""Listings, uploads, purging, logs, progress, and names by a table of types."""

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.functions import rules
from paperloom.functions.rules import Settings
from paperloom.operators import naming
from paperloom.plans import demo, progress
from paperloom.sources import ledger, readers, store
from paperloom.streaming.ingest import ingest

S = Settings()


def files(folder, **content):
    for name, text in content.items():
        path = os.path.join(folder, name.replace("__", "/") + ".pdf")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def test_listings(spark, tmp_path):
    files(tmp_path, b__z="1", b__a="22", a__x="333", a__deep__y="4", top="5")
    found = store.listed(spark, str(tmp_path))
    assert "content" not in found.columns and {(r.name, r.length) for r in found.collect()} == {("z.pdf", 1), ("a.pdf", 2), ("x.pdf", 3), ("y.pdf", 1), ("top.pdf", 1)}
    ordered = sorted(store.in_order(found).collect(), key=lambda r: r.place)
    assert [r.name for r in ordered] == ["y.pdf", "x.pdf", "a.pdf", "z.pdf", "top.pdf"] and [r.place for r in ordered] == [1, 2, 3, 4, 5]
    clients = sorted((r.client_key, r.place, r.name, r.n_documents) for r in store.by_client(found.where(F.col("path").contains("/b/"))).collect())
    assert clients == [("b", 1, "a.pdf", 2), ("b", 2, "z.pdf", 2)]
    assert store.by_client(found.where("false")).count() == store.in_order(found.where("false")).count() == 0


def test_an_upload_lands_once(spark, tmp_path):
    folder = str(tmp_path / "landing")
    up = lambda *rows: spark.createDataFrame([(n, c.encode()) for n, c in rows], "name string, content binary")
    first = store.land(up(("a b.pdf", "one"), ("c.pdf", "one"), ("d?.pdf", "two"), ("d?.pdf", "three"), ("...", "four")), folder, "20260731_090500")
    names = sorted(r.landed_name for r in first.collect())
    assert names == ["20260731_090500_a b.pdf", "20260731_090500_d (2).pdf", "20260731_090500_d.pdf", "20260731_090500_upload.pdf"]
    again = store.land(up(("other.pdf", "one"), ("e.pdf", "five")), folder, "20260731_090500")
    assert [(r.landed_name, bytes(r.content)) for r in again.collect()] == [("20260731_090500_e.pdf", b"five")]
    assert store.landed(spark, folder).count() == 5 and store.land(up(), folder, "x").count() == 0


def test_an_overtaken_landing_begins_anew(spark, tmp_path, monkeypatch):
    folder, commit, done = str(tmp_path / "landing"), ledger.Log.commit, []
    rows = spark.createDataFrame([("a.pdf", b"one"), ("b.pdf", b"two")], "name string, content binary")

    def slow(self, version, entry):
        if not done:
            done.append(1)
            store.land(rows.where("name = 'a.pdf'"), folder, "s")
        return commit(self, version, entry)

    monkeypatch.setattr(ledger.Log, "commit", slow)
    assert [r.name for r in store.land(rows, folder, "s").collect()] == ["b.pdf"] and store.landed(spark, folder).count() == 2


def test_purging_in_two_phases(spark, tmp_path):
    files(tmp_path, old__a="1", held__b="2", live__c="3", new__d="4", mixed__e="5", mixed__f="6")
    now = datetime.now()
    past = time.time() - 48 * 3600
    for name in ("old/a", "held/b", "live/c", "mixed/e"):
        os.utime(tmp_path / f"{name}.pdf", (past, past))
    folder, live = str(tmp_path), spark.createDataFrame([("live",)], "child string")
    assert store.purge(spark, folder, now, 24, live) == {"marked": ["held", "old"], "removed": []}
    store.lease(spark, folder, "batch-1", ["held"])  # a batch that began to read it meanwhile
    assert store.purge(spark, folder, now, 24, live) == {"marked": [], "removed": ["old"]}
    assert sorted(p for p in os.listdir(folder) if not p.startswith("_")) == ["held", "live", "mixed", "new"]
    store.release(spark, folder, "batch-1")
    assert store.purge(spark, folder, now, 24, live)["marked"] == ["held"]
    assert store.purge(spark, folder, now, 24, live)["removed"] == ["held"] and os.path.exists(tmp_path / "live" / "c.pdf")
    assert store.purge(spark, folder, now + timedelta(days=3), 24)["marked"] == ["live", "mixed", "new"]


def test_the_end_of_a_rotated_log(spark, tmp_path):
    lines = [f"line {k}" for k in range(500)]
    for name, part in (("app.log.10", lines[:50]), ("app.log.2", lines[50:300]), ("app.log.1", lines[300:490]), ("app.log", lines[490:])):
        (tmp_path / name).write_text("\n".join(part) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        for n in (1, 40, 205, 1000):
            got = sorted((r.place, r.line) for r in store.log_tail(spark, f"{tmp_path}/app.log*", n).collect())
            assert [x for _, x in got] == lines[-n:] and [p for p, _ in got] == list(range(1, min(n, 500) + 1))
        assert "TakeOrderedAndProject" in store.log_tail(spark, f"{tmp_path}/app.log*")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_settings_of_a_file(spark, tmp_path):
    (tmp_path / "env").write_text("# a comment\nA=1\n B = 'x = y' \nC=\nnothing\n=z\nD=\"q\"\nE='open\n")
    assert store.settings_file(spark, str(tmp_path / "env")) == {"A": "1", "B": "x = y", "C": "", "D": "q", "E": "'open"}


def test_engines_of_documents(spark):
    rows = [("a", "x y", "text"), ("a", "", "empty"), ("b", "zz", "layout"), ("b", None, "pagewise"), ("b", "q", "layout"), ("c", None, None)]
    got = {r.doc_id: (r.n_chars, r.engines, r.ocr_used) for r in readers.document_totals(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()}
    assert got == {"a": (2, ["empty", "text"], False), "b": (3, ["layout", "pagewise"], True), "c": (0, [], False)}


def test_progress_by_stages(spark, tmp_path):
    said = []
    pages = demo.pages(spark)
    batches = pages.select("doc_id").distinct().select("doc_id", F.lit(1).alias("batch_id"), F.col("doc_id").alias("upload_no"))
    out, counts = progress.analysed_by_stages(pages, batches, S, str(tmp_path / "run"), lambda m, f: said.append((m, f)))
    assert [f for _, f in said] == [0.0, 1 / 3, 2 / 3, 1.0] and said[-1][0] == "manifest: 9 rows"
    rows = out.collect()
    ready = sum(r.status == "READY" for r in rows)
    assert counts["manifest"] == {"rows": 9, "detected": 9, "ready": ready, "review": 9 - ready, "failed": 0, "exported": 9, "failures": 0}
    assert counts["segments"]["rows"] == 9 and counts["segments"]["documents"] == 7


def test_progress_of_a_stream(spark, tmp_path):
    said = []
    for k, doc in enumerate(("b_payslip", "f_blank", "d_cv")):
        demo.pages(spark).where(F.col("doc_id") == doc).coalesce(1).write.json(str(tmp_path / f"in{k}"))
    pages = spark.readStream.schema("doc_id string, page_no int, text string, headings array<string>").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*")
    ingest(pages, str(tmp_path / "out"), str(tmp_path / "at"), S, report=lambda m, f: said.append((m, f)), total=3).awaitTermination(200)
    for _ in range(100):
        if said and said[-1][0] == "stream: done":
            break
        time.sleep(0.1)
    fractions = [f for _, f in said]
    assert fractions == sorted(fractions) and fractions[0] == 0.0 and fractions[-1] == 1.0 and said[-1][0] == "stream: done" and len(said) >= 4


def people(spark):
    rows = [(k, None if k % 11 == 0 else "Brook", "A/da" if k % 2 else None, "Lu:men", ("spouse", "child", None)[k % 3], k % 4 or None, "Nora", t, "01.02.2031" if k % 2 else None, "2026-03" if k % 3 else None, "Bremen" if k % 5 else None, "Some title" if k % 2 else None)
            for k, t in enumerate([*(t.key for t in rules.CATALOGUE), "other", "unknown", "mystery", None] * 3)]
    return spark.createDataFrame(rows, "k int, last_name string, first_name string, company string, relationship string, child_index int, dependent_name string, document_type string, valid_until string, period string, city string, title string")


def test_names_by_a_table_equal_names_by_rules(spark):
    types = spark.createDataFrame([(t.key, t.label, t.relationship_in_label) for t in (*rules.CATALOGUE, rules.OTHER, rules.UNKNOWN)], "type_key string, label string, relationship_in_label boolean")
    x = people(spark).withColumn("plain", naming.file_name(S))
    both = naming.named(x, types, S).collect()
    assert len(both) == 81 and all(r.file_name == r.plain for r in both)
    by = {(r.document_type, r.k): r.file_name for r in both}
    assert by["01_passport", 0] == "01_passport_spouse_UNKNOWN_UNKNOWN_Lu men.pdf"
    assert {r.file_name[:15] for r in both if r.document_type == "mystery"} == {"00_unclassified"}


def test_a_table_of_types_has_its_own_default(spark):
    types = spark.createDataFrame([("a", "A {city}_{period}_x", True), ("unknown", "99_rest", None)], "type_key string, label string, relationship_in_label boolean")
    x = people(spark).where("k in (1, 2)").withColumn("document_type", F.when(F.col("k") == 1, "a").otherwise("b"))
    assert {r.k: r.file_name for r in naming.named(x, types, S).collect()} == {1: "A Bremen_2026-03_x_Brook_A da_Lu men.pdf", 2: "99_rest_Brook_UNKNOWN_Lu men.pdf"}
    none = types.where("false")
    assert naming.named(x, none, S).first().file_name.startswith("00_unclassified")


@pytest.mark.parametrize("label", ["{title}", "x_{city}", "pre {validity} post_{period}", "plain", "_a__b"])
def test_labels(spark, label):
    place = {"validity": "valid_until", "period": "period", "city": "city", "title": "title"}
    for r in people(spark).select("*", naming.label_part(F.lit(label), "UNKNOWN").alias("got")).limit(12).collect():
        chunks = []
        for chunk in label.split("_"):
            found = [n for n in place if "{" + n + "}" in chunk]
            if not found:
                chunks.append(chunk)
            elif r[place[found[0]]]:
                chunks.append(chunk.replace("{" + found[0] + "}", r[place[found[0]]]))
        first = label.split("_")[0]
        assert r.got == ("_".join(chunks) or ("UNKNOWN" if "{" in first else first))
