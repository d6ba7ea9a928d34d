"""The rules as data: catalogues, hints, stop-lists and constants. Any of them may be replaced by a caller's own."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DocType:
    """A document type; its keywords have weights in half points."""

    key: str
    label: str
    keywords: tuple[tuple[str, int], ...] = ()
    needs: tuple[str, ...] = ()
    relationship_in_label: bool = False


@dataclass(frozen=True)
class Settings:
    """Numbers that rules compare with. as_of stands for today and is always given, never read from a clock."""

    as_of: str = "2026-07-31"
    threshold: float = 0.90
    cap: float = 0.55
    trusted: float = 0.92
    verified: float = 0.95
    ocr_min_chars: int = 60
    max_upload_mb: int = 50
    unknown: str = "UNKNOWN"
    extra: dict = field(default_factory=dict)


def _type(key: str, label: str, keywords: tuple[tuple[str, float], ...], *needs: str, relationship: bool = False) -> DocType:
    return DocType(key, label, tuple((k, round(2 * w)) for k, w in keywords), needs, relationship)


# fmt: off
# The document types in tie-break order, with their labels, keywords, weights and required fields.
CATALOGUE = (
    _type("01_passport", "01_passport_valid {validity}", (
        ("passport", 3), ("reisepass", 3), ("passeport", 2), ("passport no", 2.5), ("passport number", 2.5), ("passnummer", 2.5),
        ("date of issue", 1), ("date of expiry", 1.5), ("nationality", 1), ("staatsangehorigkeit", 1), ("staatsangehörigkeit", 1),
        ("place of birth", 0.5), ("authority", 0.5), ("p<", 3),
    ), "validity"),
    _type("02_university_degree", "02_university degree", (
        ("bachelor", 2.5), ("master", 2.5), ("diploma", 2.5), ("diplom", 2.5), ("degree certificate", 3), ("urkunde", 2), ("university", 1.5),
        ("universitat", 1.5), ("universität", 1.5), ("hochschule", 1.5), ("faculty", 1), ("has been awarded", 1.5), ("academic degree", 2),
    )),
    _type("02.1_anabin_uni", "02.1_Anabin_uni_H+", (
        ("anabin", 3), ("h+", 2), ("hochschule status", 1.5), ("institution", 0.5),
    )),
    _type("02.2_anabin_degree", "02.2_Anabin_degree_entspricht", (
        ("anabin", 3), ("entspricht", 2.5), ("gleichwertig", 2), ("abschluss", 1.5),
    )),
    _type("03_cv", "03_CV", (
        ("curriculum vitae", 3), ("resume", 2), ("lebenslauf", 3), ("work experience", 2.5), ("berufserfahrung", 2.5),
        ("professional experience", 2.5), ("education", 1), ("skills", 1),
    )),
    _type("04_employment_contract", "04_employment contract_extension_amendment", (
        ("employment contract", 3), ("arbeitsvertrag", 3), ("contract of employment", 3), ("anstellungsvertrag", 3), ("amendment", 1.5),
        ("nachtrag", 1.5), ("extension", 1), ("probezeit", 1), ("probationary period", 1), ("gross annual salary", 1.5), ("jahresbruttogehalt", 1.5),
    )),
    _type("05_assignment_letter", "05_assignment letter", (
        ("assignment letter", 3), ("entsendevertrag", 3), ("letter of assignment", 3), ("secondment", 2.5), ("entsendung", 2.5),
        ("host company", 1.5), ("home company", 1.5),
    )),
    _type("06_job_description", "06_job description", (
        ("job description", 3), ("stellenbeschreibung", 3), ("tatigkeitsbeschreibung", 2.5), ("tätigkeitsbeschreibung", 2.5),
        ("responsibilities", 1.5), ("reports to", 1),
    )),
    _type("07_questionnaire", "07_questionnaire", (
        ("questionnaire", 3), ("fragebogen", 3), ("please answer", 1), ("erklarung zum beschaftigungsverhaltnis", 2.5),
        ("erklärung zum beschäftigungsverhältnis", 2.5),
    )),
    _type("08_poa_spouse", "08_POA_spouse", (
        ("power of attorney", 3), ("vollmacht", 3), ("spouse", 2), ("ehegatte", 2), ("ehefrau", 2), ("ehemann", 2),
    ), relationship=True),
    _type("08_poa_child", "08_POA_child", (
        ("power of attorney", 3), ("vollmacht", 3), ("child", 2), ("kind", 2), ("minor", 1.5), ("legal guardian", 1.5),
    ), relationship=True),
    _type("09_marriage_certificate", "09_marriage certificate", (
        ("marriage certificate", 3.5), ("certificate of marriage", 3.5), ("heiratsurkunde", 3.5), ("eheurkunde", 3), ("marriage", 1.5),
        ("standesamt", 1), ("date of marriage", 2),
    )),
    _type("10_birth_certificate", "10_birth certificate", (
        ("birth certificate", 3.5), ("geburtsurkunde", 3.5), ("certificate of birth", 3.5), ("date of birth", 1), ("mother", 1), ("father", 1),
        ("eltern", 1),
    )),
    _type("11_health_insurance", "11_health insurance", (
        ("health insurance", 3), ("krankenversicherung", 3.5), ("insurance certificate", 3), ("versicherungsbescheinigung", 3),
        ("mitgliedsbescheinigung", 2.5), ("aok", 1.5), ("techniker krankenkasse", 2), ("policy number", 1),
    )),
    _type("12_payslip", "12_payslip_{period}", (
        ("payslip", 3.5), ("pay slip", 3.5), ("payroll", 3), ("gehaltsabrechnung", 3.5), ("lohnabrechnung", 3.5), ("entgeltabrechnung", 3.5),
        ("net pay", 1.5), ("gross pay", 1.5), ("steuerklasse", 1.5), ("sozialversicherung", 1),
    ), "period"),
    _type("13_rental_agreement", "13_rental agreement", (
        ("rental agreement", 3), ("mietvertrag", 3.5), ("lease agreement", 3), ("landlord", 1.5), ("vermieter", 1.5), ("tenant", 1.5),
        ("mieter", 1.5), ("kaltmiete", 1.5),
    )),
    _type("14_fea_pre_approval", "14_FEA pre-approval note", (
        ("pre-approval", 3), ("vorabzustimmung", 3.5), ("bundesagentur fur arbeit", 3), ("bundesagentur für arbeit", 3),
        ("federal employment agency", 3), ("zustimmung", 1.5),
    )),
    _type("15_visa", "15_visa_valid {validity}", (
        ("visa", 3.5), ("visum", 3.5), ("schengen", 2), ("number of entries", 2.5), ("entries", 1.5), ("category", 1.5), ("duration of stay", 2),
        ("valid for", 1.5), ("type: d", 1.5),
    ), "validity"),
    _type("16_town_hall_registration", "16_town hall registration_{city}", (
        ("meldebescheinigung", 3.5), ("anmeldung", 3), ("registration certificate", 3), ("town hall registration", 3), ("einwohnermeldeamt", 2.5),
        ("burgeramt", 2), ("bürgeramt", 2), ("wohnung", 1), ("registered address", 1.5),
    ), "city"),
    _type("17_interim_permit", "17_interim permit_valid {validity}", (
        ("fiktionsbescheinigung", 3.5), ("interim permit", 3), ("provisional residence", 3), ("vorlaufige", 1.5), ("vorläufige", 1.5),
    ), "validity"),
    _type("18_wp", "18_WP_valid {validity}", (
        ("aufenthaltstitel", 3.5), ("residence permit", 3), ("work permit", 3), ("supplementary sheet", 2.5), ("zusatzblatt", 2.5),
        ("blaue karte eu", 3), ("eu blue card", 3), ("erwerbstatigkeit gestattet", 2), ("erwerbstätigkeit gestattet", 2),
    ), "validity"),
    _type("19_rp_dependents", "19_RP_dependents_valid {validity}", (
        ("aufenthaltstitel", 2), ("residence permit", 2), ("familiennachzug", 3), ("family reunification", 3), ("dependent", 2),
        ("ehegattennachzug", 3),
    ), "validity"),
    _type("20_town_hall_deregistration", "20_town hall de-registration_{city}", (
        ("abmeldung", 3.5), ("abmeldebescheinigung", 3.5), ("de-registration", 3), ("deregistration", 3), ("wegzug", 2), ("moving out", 1.5),
    ), "city"),
)
# What the types are called in prompts.
DESCRIPTIONS = {
    "01_passport": "Passport",
    "02_university_degree": "University degree / diploma",
    "02.1_anabin_uni": "Anabin university status (H+)",
    "02.2_anabin_degree": "Anabin degree equivalence",
    "03_cv": "Curriculum vitae",
    "04_employment_contract": "Employment contract / extension / amendment",
    "05_assignment_letter": "Assignment letter",
    "06_job_description": "Job description",
    "07_questionnaire": "Questionnaire",
    "08_poa_spouse": "Power of attorney - spouse",
    "08_poa_child": "Power of attorney - child",
    "09_marriage_certificate": "Marriage certificate",
    "10_birth_certificate": "Birth certificate",
    "11_health_insurance": "Health insurance confirmation",
    "12_payslip": "Payslip",
    "13_rental_agreement": "Rental agreement",
    "14_fea_pre_approval": "Federal Employment Agency pre-approval note",
    "15_visa": "Visa",
    "16_town_hall_registration": "Town hall registration (Anmeldung)",
    "17_interim_permit": "Interim / provisional residence permit (Fiktionsbescheinigung)",
    "18_wp": "Work permit / residence title of the main applicant",
    "19_rp_dependents": "Residence permit of a dependent",
    "20_town_hall_deregistration": "Town hall de-registration (Abmeldung)",
    "unknown": "Could not be classified - manual review required",
    "other": "Other document (outside the naming convention)",
}
UNKNOWN = DocType("unknown", "00_unclassified")
OTHER = DocType("other", "{title}", needs=("title",))

#: Function words as types, for tables without any of the real keywords.
LANGUAGES = (
    _type("en", "en", (
        ("the", 1), ("and", 1), ("of", 0.5),
    )),
    _type("de", "de", (
        ("und", 1.5), ("der", 1), ("die", 1),
    )),
    _type("fr", "fr", (
        ("les", 1.5), ("pour", 1), ("dans", 1),
    )),
    _type("es", "es", (
        ("los", 1.5), ("para", 1), ("del", 1),
    )),
)

# Confidence by best score (in half points), plain and with a close runner-up, before the cap.
CONFIDENCE = {5: 0.362, 6: 0.375, 7: 0.387, 8: 0.4, 9: 0.412, 10: 0.425, 11: 0.438, 12: 0.45, 13: 0.463, 14: 0.475, 15: 0.487, 16: 0.5, 17: 0.512, 18: 0.525, 19: 0.537}
AMBIGUOUS = {5: 0.262, 6: 0.275, 7: 0.287, 8: 0.3, 9: 0.312, 10: 0.325, 11: 0.338, 12: 0.35, 13: 0.363, 14: 0.375, 15: 0.387, 16: 0.4, 17: 0.412, 18: 0.425, 19: 0.438, 20: 0.45, 21: 0.463, 22: 0.475, 23: 0.487}
CONFIDENCE_TOP, AMBIGUOUS_TOP = 0.55, 0.5

# Words and patterns that the extraction compares with.
RELATIONSHIPS = {
    "spouse": "spouse", "wife": "spouse", "husband": "spouse", "ehepartner": "spouse", "ehegatte": "spouse", "ehefrau": "spouse",
    "ehemann": "spouse", "partner": "spouse", "child": "child", "son": "child", "daughter": "child", "kind": "child", "sohn": "child",
    "tochter": "child", "minor": "child", "self": "", "applicant": "", "main applicant": "", "principal": "", "employee": "",
    "none": "", "n/a": "", "-": "",
}
LABEL_WORDS = (
    "surname", "surnames", "family", "name", "names", "nachname", "familienname", "given", "first", "last", "forename", "vorname", "vornamen",
    "remarks", "date", "datum", "nationality", "staatsangehorigkeit", "staatsangehörigkeit", "sex", "geschlecht", "birth", "geburt", "geburtsdatum",
    "place", "ort", "employer", "arbeitgeber", "company", "firma", "city", "stadt", "wohnort", "abrechnungsmonat", "abrechnungszeitraum", "type",
    "code", "authority", "passport", "issue", "expiry", "valid", "no", "nr", "number", "geboren", "und", "and", "wohnhaft", "vertreten", "vater",
    "father", "mutter", "mother", "eltern", "parents", "kind", "child", "wife", "husband", "ehefrau", "ehemann", "standesamt", "registrar", "born",
    "geb",
)
NOT_A_PERSON = (
    "curriculum", "vitae", "lebenslauf", "resume", "cv", "profile", "profil", "contact", "kontakt", "address", "adresse", "experience", "erfahrung",
    "education", "ausbildung", "skills", "kenntnisse", "languages", "sprachen", "certificate", "urkunde", "bescheinigung", "vertrag", "contract",
    "invoice", "rechnung", "sheet", "information", "travel", "business", "passport", "reisepass", "visa", "visum", "gmbh", "ag", "limited", "inc",
    "university", "universitat", "universität", "hochschule", "seite", "page", "datum", "date", "standesamt", "registrar", "amt", "stadt", "city",
    "republik", "republic", "bundesrepublik", "federal", "deutschland", "germany", "krankenkasse", "versicherung", "insurance", "arbeitsvertrag",
    "employment", "payslip", "gehaltsabrechnung", "lohnabrechnung", "anmeldung", "abmeldung",
)
TITLES = ("MB Business Contact", "Travel Information Sheet", "Cover Letter", "Application Form", "Data Privacy Consent", "Certificate of Enrolment", "Confirmation of Employment", "Letter of Recommendation", "Bank Statement", "Tax Assessment")
EXPIRY_HINTS = ("date of expiry", "valid until", "valid till", "expiry date", "expires", "gültig bis", "gultig bis", "gueltig bis", "befristet bis", "date d'expiration")
PERIOD_HINTS = ("abrechnungsmonat", "abrechnungszeitraum", "pay period", "period", "monat", "month")
EMPLOYER_SECTIONS = ("work experience", "professional experience", "berufserfahrung", "employment history", "beruflicher werdegang", "arbeitgeber")
MONTHS = {
    "januar": "jan", "februar": "feb", "marz": "mar", "märz": "mar", "mrz": "mar", "mai": "may", "juni": "jun", "juli": "jul", "sept": "sep",
    "oktober": "oct", "okt": "oct", "dezember": "dec", "dez": "dec", "january": "jan", "february": "feb", "march": "mar", "april": "apr",
    "june": "jun", "july": "jul", "august": "aug", "september": "sep", "october": "oct", "november": "nov", "december": "dec",
}
_NAME = r"[A-ZÄÖÜ][\w'\-äöüßéèêáàâç]*"
_H = r"[^\S\r\n]"
_SEP = r"(?:[^\n:]{0,40}:)?[^\S\r\n]*"
LABELS = {
    "last_name": rf"(?:surname|family\s*name|last\s*name|name\s*/\s*surname|nachname|familienname){_SEP}({_NAME}(?:{_H}+{_NAME})?)",
    "first_name": rf"(?:given\s*names?|first\s*name|forename|vorname[n]?){_SEP}({_NAME}(?:{_H}+{_NAME})?)",
    "company": rf"(?:employer|company|arbeitgeber|firma|unternehmen|host\s*company){_SEP}([A-Z0-9ÄÖÜ][\w&.,'\-äöüß ]{{2,45}})",
    "city": rf"(?:city|town|stadt|wohnort|ort\s*der\s*anmeldung|gemeinde|municipality){_SEP}({_NAME}(?:{_H}{_NAME})?)",
}
ANCHORS = {
    "09_marriage_certificate": {
        "full_name": rf"(?:husband|ehemann|spouse\s*1|partner\s*1){_SEP}({_NAME}(?:{_H}+{_NAME}){{0,2}})",
        "city": rf"standesamt{_H}+({_NAME}(?:{_H}{_NAME})?)",
    },
    "10_birth_certificate": {
        "dependent_name": rf"(?:name\s*(?:des\s*kindes|of\s*the\s*child)|kind|child){_SEP}({_NAME}(?:{_H}+{_NAME})?)",
        "full_name": rf"(?:vater|father){_SEP}({_NAME}(?:{_H}+{_NAME}){{0,2}})",
        "city": rf"standesamt{_H}+({_NAME}(?:{_H}{_NAME})?)",
    },
    "12_payslip": {"period": rf"(?:abrechnungsmonat|abrechnungszeitraum|pay{_H}*period|lohnmonat){_SEP}(\d{{1,2}}\s?[./-]\s?\d{{4}}|\d{{4}}\s?-\s?\d{{1,2}})"},
    "04_employment_contract": {"company": r"zwischen\s+(?:der\s+|dem\s+)?([A-Z0-9ÄÖÜ][\w&.,'\-äöüß ]{2,50}?)\s+und\b"},
    "03_cv": {"city": rf"(?:address|anschrift|wohnhaft\s*in){_SEP}(?:[^\n]{{0,40}}?\b\d{{5}}{_H}+)?({_NAME})"},
    "05_assignment_letter": {"company": r"(?:host\s*company|gastunternehmen|aufnehmendes\s*unternehmen)\s*[:\-]?\s*([A-Z0-9ÄÖÜ][\w&.,'\-äöüß ]{2,45})"},
}
POSTCODE_CITY = rf"\b\d{{5}}\s+({_NAME}(?:[- ]{_NAME})?)"
LEGAL_FORMS = (
    r"(?:GmbH\s*&\s*Co\.?\s*KGaA|GmbH\s*&\s*Co\.?\s*KG|gGmbH|GmbH|mbH|AG|SE|KGaA|KG|OHG|GbR|e\.?\s?K\.?|Ltd\.?|Limited|LLC|L\.L\.C\.|Inc\.?|Incorporated|"
    r"Corp\.?|Corporation|PLC|B\.?V\.?|N\.?V\.?|S\.?A\.?R\.?L\.?|S\.?A\.?S\.?|S\.?A\.?|S\.?p\.?A\.?|S\.?L\.?|Oy|AB|A/S|Pty\.?\s*Ltd\.?|Sp\.\s?z\s?o\.o\.)"
)
COMPANY = rf"\b([A-ZÄÖÜ][\w.&'\-äöüß]*(?:[ ][A-ZÄÖÜ0-9][\w.&'\-äöüß]*){{0,4}}[ ]{LEGAL_FORMS})(?!\w)"
DATES = r"\b(?:\d{1,2}[.\-/\s]\d{1,2}[.\-/\s]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}\s?[A-Za-zÄÖÜäöü]{3,9}\s?\d{4})\b"
MRZ_1 = r"P[<A-Z][A-Z<]{3}([A-Z]+(?:<[A-Z]+)*)<<([A-Z]+(?:<[A-Z]+)*)"
MRZ_2 = r"([A-Z0-9<]{9})(\d)([A-Z<]{3})(\d{6})(\d)([MFX<])(\d{6})(\d)([A-Z0-9<]{14})(\d)(\d)"
