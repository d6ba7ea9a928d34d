"""Small invented documents that take every path of the analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MRZ = "P<GBRBROOK<<ADA<<<<<<<<<<<<<<<<<<<<<<<<<<<<<\nK7M20319Q0GBR9011045F3105227<<<<<<<<<<<<<<02"
#: The same with a wrong digit of the document number.
BROKEN_MRZ = "P<GBRBROOK<<ADA<<<<<<<<<<<<<<<<<<<<<<<<<<<<<\nK7M20319Q1GBR9011045F3105227<<<<<<<<<<<<<<02"

#: doc_id, page_no, text, headings
PAGES = [
    ("a_bundle", 1, "PASSPORT\nPassport No: K7M20319Q\nSurname: BROOK\nGiven names: ADA\nDate of expiry: 22.05.2031\n" + MRZ, []),
    ("a_bundle", 2, "Passport number K7M20319Q, further remarks: none", []),
    ("a_bundle", 3, "VISUM / Visa, number of entries: one\nValid until: 01.02.2029\nSurname: BROOK   Given names: ADA\nEmployer: Lumen Optik", []),
    ("a_bundle", 4, "Heiratsurkunde\nStandesamt Bremen\nHusband: Theo Brook, born 1988", []),
    ("a_bundle", 5, "Marriage certificate, second sheet\nEntry 77", []),
    ("b_payslip", 1, "Gehaltsabrechnung\nArbeitgeber: Lumen Optik GmbH\nNachname: Brook    Vorname: Ada\nAbrechnungsmonat: 03/2026\nNet pay 3.100,00", []),
    ("c_birth", 1, "Geburtsurkunde\nStandesamt Bremen\nName of the child: Nora Brook\nFather: Theo Brook", []),
    ("d_cv", 1, "Ada Brook\nCurriculum Vitae\nEducation at Northgate Labs Ltd\nWork experience\nsince 2020 Lumen Optik GmbH, Bremen\nSkills", ["Ada Brook", "Curriculum Vitae"]),
    ("e_other", 1, "MB BUSINESS CONTACT\nLast name: Brook\nFirst name: Ada\nEmployer: Lumen Optik GmbH", ["MB BUSINESS CONTACT"]),
    ("f_blank", 1, "", []),
    ("g_broken", 1, "PASSPORT passport no\n" + BROKEN_MRZ, []),
]


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "doc_id string, page_no int, text string, headings array<string>")


#: What a model answers about the demo documents, by a string that its question holds; the first call about one of them fails.
ANSWERS = {
    "Name of the child: Nora": '{"documents": [{"document_type": "10_birth_certificate", "first_name": "Theo", "last_name": "Brook", "company": "Lumen Optik GmbH", "relationship": "daughter", "dependent_name": "Nora", "child_index": 1, "confidence": 0.93}]}',
    "Heiratsurkunde": '```json\n{"documents": [{"document_type": "09_marriage_certificate", "company": "Lumen Optik GmbH", "confidence": 0.96}]}\n```',
    "K7M20319Q1": '{"document_type": "01_passport", "first_name": "Ada", "last_name": "Brook", "company": "Lumen Optik", "valid_until": "22.05.2031", "confidence": 0.91}',
    "K7M20319Q": '{"document_type": "03_cv", "first_name": "Eve", "last_name": "Wrong", "company": "Lumen Optik", "confidence": 0.5}',
}
FAILURES = {"Heiratsurkunde": 1}
