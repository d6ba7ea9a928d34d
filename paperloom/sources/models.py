"""Language models as providers: what they are asked, how answers come back, and which rows reach them.

A provider is an object with three members that runs on executors, batch by batch; the stand-in here answers from a table, as real
ones need a server. Failed calls are tried again within the worker that made them; what still fails is an error column of that row alone.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import settled
from ..functions.rules import CATALOGUE, DESCRIPTIONS, DocType, Settings
from ..operators.merge import entries, improve, model_segments, needs_help, verified_over
from ..operators.segment import ordered_text, repaired
from .ledger import answered

LONGEST_PROMPT = 12_000
EXTRAS = {"validity": "needs valid_until", "period": "needs period (YYYY-MM)", "city": "needs city"}


def no_wait(seconds: float) -> None:
    """Instead of time.sleep, where calls are answered at once."""


class Model(Protocol):
    name: str

    def available(self) -> bool: ...

    def complete(self, system: str, user: str) -> str: ...


@dataclass
class NoModel:
    name: str = "rules only"

    def available(self) -> bool:
        return False

    def complete(self, system: str, user: str) -> str:
        raise ConnectionError("no model is configured")


@dataclass
class TableModel:
    """Answers with the entry of the first key that the question contains. failures: how many calls of a question fail first."""

    answers: dict[str, str]
    failures: dict[str, int] = field(default_factory=dict)
    name: str = "table"
    _calls: dict[str, int] = field(default_factory=dict)

    def available(self) -> bool:
        return True

    def complete(self, system: str, user: str) -> str:
        for key, answer in self.answers.items():
            if key in user:
                self._calls[key] = self._calls.get(key, 0) + 1
                if self._calls[key] <= self.failures.get(key, 0):
                    raise ConnectionError(f"call {self._calls[key]} failed")
                return answer
        return ""


class ListedModel:
    """A model of a server that can be asked which models it has. Whether it is there is found out once, and again after `refresh`.

    A name without its tag (what follows a colon) stands for every tag. installed: the names that the server has; any failure counts as none.
    """

    def __init__(self, name: str, installed: Callable[[], Sequence[str]], call: Callable[[str, str], str]):
        self.name, self.installed, self.call, self._there = name, installed, call, None

    def available(self) -> bool:
        if self._there is None:
            try:
                names = list(self.installed())
            except Exception:  # a server that is down has no models
                names = []
            bare = lambda n: n.split(":")[0]
            self._there = bool(self.name) and any(n == self.name or bare(n) == bare(self.name) for n in names)
        return self._there

    def refresh(self) -> bool:
        self._there = None
        return self.available()

    def complete(self, system: str, user: str) -> str:
        return self.call(system, user)


def choose(wanted: str, local: Model | None, cloud: Model | None) -> Model:
    """The model for a setting: auto takes the local one, then the cloud one, of those that are available."""
    options = {"auto": (local, cloud), "local": (local,), "cloud": (cloud,)}.get(wanted, ())
    return next((m for m in options if m is not None and m.available()), NoModel())


# --- what is asked ---


def label_order(label: Column) -> Column:
    """What labels sort by: the part before the first underscore."""
    return F.substring_index(label, "_", 1)


def prompt_line(key: Column, description: Column, needs: Column) -> Column:
    """A line of the catalogue in a prompt. needs: an array of the extras of a type, maybe empty."""
    extras = F.when(F.size(needs) > 0, F.concat(F.lit(" ["), F.array_join(needs, ", "), F.lit("]"))).otherwise("")
    return F.concat(F.lit('- "'), key, F.lit('": '), description, extras)


def catalogue_block(catalogue: Sequence[DocType] = CATALOGUE) -> str:
    """The catalogue as lines, in the order of the labels."""
    extras = lambda t: [x for n, x in EXTRAS.items() if n in t.needs]
    line = lambda t: f'- "{t.key}": {DESCRIPTIONS.get(t.key, t.label)}' + (f" [{', '.join(extras(t))}]" if extras(t) else "")
    return "\n".join(line(t) for t in sorted(catalogue, key=lambda t: t.label))


def system_prompt(template: str, catalogue: Sequence[DocType] = CATALOGUE) -> str:
    return template.replace("{{DOCUMENT_TYPES}}", catalogue_block(catalogue))


def whole_question(name: Column, page_count: Column, ocr_used: Column, snippet: Column) -> Column:
    """The question about a whole document: its name, pages, and text with page marks."""
    used = F.when(ocr_used, "yes").otherwise("no")
    head = F.concat(F.lit("File name: "), name, F.lit("\nTotal pages: "), page_count.cast("string"), F.lit("\nOCR used: "), used)
    return F.concat(head, F.lit("\n\nDocument text (page markers included):\n"), F.substring(snippet, 1, LONGEST_PROMPT))


def single_question(text: Column, page_count: Column, hint: Column) -> Column:
    """The question about one segment, whose boundaries are known. hint: what kind it is thought to be, or null."""
    n = page_count.cast("string")
    about = F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit(" ("), hint, F.lit(")"))).otherwise("")
    return F.concat(
        F.lit("This text contains exactly ONE document"), about, F.lit(" on "), n, F.lit(" page(s). Return it as a single entry in the documents array with start_page 1 and end_page "),
        n, F.lit(".\n\n"), F.substring(text, 1, LONGEST_PROMPT),
    )


def is_object(answer: str | None) -> bool:
    """Whether what stands between the outer braces of an answer is a JSON object."""
    try:
        return isinstance(json.loads(answer[answer.index("{") : answer.rindex("}") + 1]), dict)
    except (AttributeError, ValueError):
        return False


def ask(rows: DataFrame, model: Model, system: str, attempts: int, wait: Callable[[float], None] = time.sleep, ledger: str | None = None, waves: int = 1) -> DataFrame:
    """rows (with question) with answer and failure. A call that fails, or an answer that holds no JSON object, is tried again after 2, 4, ... up to 8 seconds.

    ledger: a folder that keeps answers (`sources.ledger.answered`): equal questions are asked once, also by later runs, and each answer is stored before it is used.
    """

    def one(question: str) -> tuple[str | None, str | None]:
        why = None
        for attempt in range(1, attempts + 1):
            try:
                answer = model.complete(system, question)
                if is_object(answer):
                    return answer, None
                why = "answer is not JSON"
            except Exception as e:  # a provider must not end the job
                why = f"{type(e).__name__}: {e}"
            if attempt < attempts:
                wait(min(2**attempt, 8))
        return None, f"{model.name} request failed: {why}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [one(q) for q in batch.pop("question")]
            batch["answer"], batch["failure"] = [a for a, _ in got], [w for _, w in got]
            yield batch

    def call(x: DataFrame) -> DataFrame:
        schema = x.drop("question").selectExpr("*", "cast(null as string) answer", "cast(null as string) failure").schema
        return x.mapInPandas(run, schema)

    return answered(rows, ledger, model.name, system, call, waves) if ledger else call(rows)


# --- which rows reach a model ---


def grouping_uncertain(segments: DataFrame) -> DataFrame:
    """(doc_id, uncertain): whether any segment of a document is of unknown type."""
    return segments.groupBy("doc_id").agg(F.bool_or(F.col("document_type") == "unknown").alias("uncertain"))


def routed(segments: DataFrame, settings: Settings) -> DataFrame:
    """segments (scored) with route: whole, if the document has an unknown segment; single, if this segment needs help; rules else."""
    unknown = F.col("document_type") == "unknown"
    per_doc = segments.groupBy("doc_id").agg(F.bool_or(unknown).alias("_unknown"))
    route = F.when(F.col("_unknown"), "whole").when(needs_help(segments, settings), "single").otherwise("rules")
    return segments.join(per_doc, "doc_id").withColumn("route", route).drop("_unknown")


def with_model(
    segments: DataFrame, pages: DataFrame, model: Model, settings: Settings, system: str = "", wait: Callable[[float], None] = time.sleep, first: bool = False, ledger: str | None = None
) -> DataFrame:
    """Scored rule segments completed by a model: documents with an unknown segment are asked about as a whole, other weak segments one by one.

    pages: doc_id, page_no, text. A document whose whole answer fails has its weak segments asked one by one as well. Texts without a character and failed calls leave
    the rules' result. What check digits verified stays over the model's answer, and whole answers are repaired so that every page is in one segment. first: every
    document is asked about as a whole first, and that answer stands as it is; only those that it fails for take the way above. ledger: see `ask`. Without a
    model nothing changes.
    """
    if not model.available():
        return segments
    columns = segments.columns
    docs = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"), ordered_text(mark=True).alias("_snippet"), F.max(F.length(F.trim("text"))).alias("_size"))
    question = whole_question(F.col("doc_id").cast("string"), F.col("page_count"), F.lit(False), F.col("_snippet"))

    def asked_whole(wanted: DataFrame) -> DataFrame:
        """(doc_id, page_count, answer) of documents whose answer has entries. Settled, so that no use of it asks again."""
        todo = docs.join(wanted, "doc_id", "left_semi").where("_size > 0").select("doc_id", "page_count", question.alias("question"))
        return settled(ask(todo, model, system, 3, wait, ledger).where(F.size(entries(F.col("answer"))) > 0))

    def finished(whole: DataFrame, answers: DataFrame) -> DataFrame:
        whole = repaired(whole, answers.select("doc_id", "page_count"))
        missing = [c for c in columns if c not in whole.columns]
        whole = whole.withColumns({c: F.lit("model") if c == "source" else F.lit(0.0 if c == "keyword_confidence" else None).cast(segments.schema[c].dataType) for c in missing})
        return whole.select(*(F.col(c).cast(segments.schema[c].dataType).alias(c) for c in columns))

    none = F.array().cast(segments.schema["evidence"].dataType)
    out = None
    if first:
        answers = asked_whole(docs.select("doc_id"))
        out = finished(model_segments(answers).withColumn("evidence", none), answers)
        segments = segments.join(answers, "doc_id", "left_anti")
    marked = routed(segments, settings)
    uncertain = marked.where("route = 'whole'")
    # in the first mode their whole answer failed already
    answers = asked_whole(uncertain.select("doc_id").distinct().where(F.lit(not first)))
    ruled = uncertain.withColumn("verified", F.exists("evidence", lambda e: e["kind"] == "verified"))
    whole = finished(verified_over(model_segments(answers).withColumn("evidence", none), ruled), answers)
    rest = marked.join(answers, "doc_id", "left_anti")
    helped = needs_help(rest, settings)
    weak = rest.where(helped).withColumn("id", F.struct("doc_id", "seg_no"))
    known = F.create_map(*(F.lit(x) for k, d in DESCRIPTIONS.items() if k != "unknown" for x in (k, d)))
    about = F.try_element_at(known, F.col("document_type"))
    ready = weak.where(F.length(F.trim("text")) > 0).select("id", single_question(F.col("text"), F.col("end_page") - F.col("start_page") + 1, about).alias("question"))
    single = improve(weak, ask(ready, model, system, 2, wait, ledger)).select(*columns)
    every = rest.where(~helped).select(*columns).unionByName(single).unionByName(whole)
    return every if out is None else every.unionByName(out)
