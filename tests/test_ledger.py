"""Ledgers of names and answers, and what the model facade does when calls fail."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from paperloom.functions.order import settled
from paperloom.functions.rules import Settings
from paperloom.operators import extract, score
from paperloom.plans import analyse, demo
from paperloom.sources import ledger, models

S = Settings()


def counted(path, answers, failures=None):
    """A model that notes each call in a file. Its class is local, so that it is sent to workers by value."""

    class Counted(models.TableModel):
        def complete(self, system, user):
            with open(str(path), "a") as f:
                f.write(f"{user[:60]!r}\n")
            return super().complete(system, user)

    return Counted(answers, failures or {})


def calls(path):
    return open(path).read().count("\n") if os.path.exists(path) else 0


def filed(spark, n, status="READY"):
    none = F.lit(None).cast("string")
    x = spark.range(n).select("id", F.lit("03_cv").alias("document_type"), F.lit("Brook").alias("last_name"), F.lit("Ada").alias("first_name"), F.lit("Lumen").alias("company"), F.col("id").alias("doc_ordinal"), (F.col("id") % 2 == 0).alias("requires_review"), none.alias("error"))
    return x.withColumns({c: none for c in ("valid_until", "city", "period", "title", "relationship", "dependent_name")} | {"child_index": F.lit(None).cast("int"), "status": F.lit(status)})


def names(df):
    return sorted((r.target_dir, r.unique_name) for r in df.collect())


def test_a_batch_that_is_exported_twice_keeps_its_names(spark, tmp_path):
    folder = str(tmp_path / "filed")
    assert ledger.claimed(spark, folder) is None
    one = names(ledger.export(filed(spark, 4), S, folder, "a"))
    two = names(ledger.export(filed(spark, 4), S, folder, "b"))
    assert names(ledger.export(filed(spark, 4), S, folder, "a")) == one and not set(one) & set(two)
    assert names(ledger.claimed(spark, folder)) == sorted(one + two)


def test_exports_beside_each_other_give_each_name_once(spark, tmp_path):
    folder, out = str(tmp_path / "filed"), {}

    def run(batch):
        out[batch] = names(ledger.export(filed(spark, 4), S, folder, batch))

    threads = [threading.Thread(target=run, args=(f"b{k % 3}",)) for k in range(4)]  # b0 twice
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    every = sum(out.values(), [])
    assert len(every) == len(set(every)) == 12 and names(ledger.claimed(spark, folder)) == sorted(every)


def test_an_export_that_was_overtaken_numbers_anew(spark, tmp_path, monkeypatch):
    folder, commit, done = str(tmp_path / "filed"), ledger.Log.commit, []

    def slow(self, version, entry):
        if not done:
            done.append(1)
            ledger.export(filed(spark, 2), S, folder, "fast")
        return commit(self, version, entry)

    monkeypatch.setattr(ledger.Log, "commit", slow)
    got = names(ledger.export(filed(spark, 2), S, folder, "slow"))
    assert all("(2)" in n for _, n in got) and len(names(ledger.claimed(spark, folder))) == 4


def test_a_run_that_dies_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "filed")
    monkeypatch.setattr(ledger.Log, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        ledger.export(filed(spark, 2), S, folder, "a")
    monkeypatch.undo()
    assert ledger.claimed(spark, folder) is None
    assert all("(" not in n for _, n in names(ledger.export(filed(spark, 2), S, folder, "a")))


def test_a_commit_is_made_once(spark, tmp_path):
    log = ledger.Log(spark, str(tmp_path / "l"))
    assert log.entries() == [] and log.commit(1, {"a": 1}) and not log.commit(1, {"a": 2}) and log.commit(2, {"a": "ü"})
    assert log.entries() == [{"a": 1}, {"a": "ü"}]


def test_answers_are_asked_for_once(spark, tmp_path):
    folder, path = str(tmp_path / "answers"), tmp_path / "calls"
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(["good", "good", "bad", "other good", None])], "id int, question string").repartition(3)
    model = counted(path, {"good": '{"a": 1}', "bad": "{oops}"})
    ask = lambda m, waves=1: {r.id: (r.answer, r.failure) for r in models.ask(rows, m, "sys", 2, models.no_wait, folder, waves).collect()}
    first = ask(model, 3)
    assert first == {0: ('{"a": 1}', None), 1: ('{"a": 1}', None), 2: (None, "table request failed: answer is not JSON"), 3: ('{"a": 1}', None), 4: (None, None)}
    assert calls(path) == 4  # two questions, and the bad one twice
    assert ask(model) == first and calls(path) == 6  # only what failed is asked again
    better = counted(path, {"bad": '{"b": 2}'})
    assert ask(better)[2] == ('{"b": 2}', None) and calls(path) == 7
    assert models.ask(rows, better, "other prompt", 1, models.no_wait, folder).count() == 5 and calls(path) == 10  # another prompt is another question


def ruled(spark, rows):
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string, headings array<string>")
    return settled(score.score(extract.extract(analyse.segmented(pages), S), S)), pages


PAGES = [("m", 1, "nothing to go by", []), ("m", 2, "Gehaltsabrechnung\nAbrechnungsmonat: 03/2026\nnet pay", []), ("n", 1, "zzz", []), ("p", 1, "Gehaltsabrechnung payslip", [])]
SINGLE = '{"document_type": "12_payslip", "first_name": "Ada", "last_name": "Brook", "company": "Lumen", "period": "2026-03", "confidence": 0.97}'


def test_weak_segments_are_asked_about_when_the_whole_answer_fails(spark):
    class Picky(models.TableModel):
        """Knows nothing of whole documents."""

        def complete(self, system, user):
            return "{oops}" if user.startswith("File name") else super().complete(system, user)

    found, pages = ruled(spark, PAGES)
    out = {(r.doc_id, r.start_page): r for r in models.with_model(found, pages, Picky({"Gehaltsabrechnung": SINGLE}), S, wait=models.no_wait).collect()}
    assert out["m", 2].source == "model" and out["m", 2].last_name == "Brook" and out["m", 2].confidence == 0.97
    assert out["m", 1].source == out["n", 1].source == "rules" and out["p", 1].source == "model" and len(out) == 4


def test_the_model_first(spark):
    found, pages = ruled(spark, PAGES)
    whole = '{"documents": [{"document_type": "03_cv", "start_page": 1, "end_page": 1, "last_name": "Wolf", "confidence": 0.8}]}'
    model = models.TableModel({"File name: p": whole, "This text": SINGLE})
    out = {(r.doc_id, r.start_page): r for r in models.with_model(found, pages, model, S, wait=models.no_wait, first=True).collect()}
    assert (out["p", 1].document_type, out["p", 1].last_name, out["p", 1].source) == ("03_cv", "Wolf", "model")
    # the whole answers about m and n failed: their weak segments are asked about one by one
    assert out["m", 1].document_type == out["n", 1].document_type == "12_payslip" and out["m", 2].last_name == "Brook" and len(out) == 4


def test_a_ledger_saves_all_calls_of_a_second_run(spark, tmp_path):
    path = tmp_path / "calls"
    found, pages = ruled(spark, PAGES)
    run = lambda: sorted((r.doc_id, r.start_page, r.document_type, r.source) for r in models.with_model(found, pages, counted(path, {"File name: n": "{}", "Gehalts": SINGLE, "This": SINGLE}), S, wait=models.no_wait, ledger=str(tmp_path / "l")).collect())
    first, n = run(), calls(path)
    assert run() == first and calls(path) == n > 0


def test_answers_are_objects():
    assert models.is_object('```json\n{"a": {}}\n```') and models.is_object("so: {} ok")
    assert not any(map(models.is_object, (None, "", "{oops}", "[]", "}{", "{} {}")))


def test_models_of_a_server():
    asked = []

    def installed():
        asked.append(1)
        if len(asked) == 1:
            raise OSError("down")
        return ["small:latest", "big:7b"]

    m = models.ListedModel("big", installed, lambda s, u: "{}")
    assert not m.available() and not m.available() and len(asked) == 1  # remembered
    assert m.refresh() and m.available() and len(asked) == 2
    there = lambda name: models.ListedModel(name, lambda: ["small:latest", "big:7b"], None).available()
    assert there("small:latest") and there("small:other") and not there("smal") and not there("")


def test_the_plan_takes_providers(spark, tmp_path):
    pages = demo.pages(spark).where("doc_id in ('b_payslip', 'c_birth', 'f_blank')")
    batches = pages.select("doc_id").distinct().select("doc_id", F.lit(1).alias("batch_id"), F.col("doc_id").alias("upload_no"))
    filled = lambda p: p.withColumn("text", F.when(F.col("doc_id") == "f_blank", "Name of the child: Nora").otherwise(F.col("text")))
    model = models.TableModel(demo.ANSWERS, demo.FAILURES)
    out = {r.doc_id: r for r in analyse.analysed(pages, batches, S, ocr=filled, model=model, ledger=str(tmp_path / "l"), wait=models.no_wait).collect()}
    assert out["c_birth"].source == out["f_blank"].source == "model" and out["c_birth"].dependent_name == "Nora" and out["b_payslip"].source == "rules"
