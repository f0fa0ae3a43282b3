"""Verification of extracted fields against the page they come from, and document classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.functions.text import folded, nfkc

# Answers that are a form's own words, and fields whose text is rewritten rather than copied.
PLACEHOLDER = r"(?i)^\s*(\[[^\]]*\]|\{[^}]*\}|<[^>]*>|n/?a|none|null|nil|tbd|xxx+|--+|lorem\b.*|your\s+\w+|sample\s+\w+|enter\s+\w+|description|placeholder|text\s+here|company\s+name|full\s+name)\s*$"
REWRITTEN = ["summary", "objective", "description", "responsibilities", "about", "profile", "state", "city", "country", "designation_normalised"]
RIVALS = ["enrollment_date", "issue_date", "date_of_issue", "print_date"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def legible(text: Column, width: Column, height: Column) -> Column:
    """At least 400 pixels on the shorter side and five words."""
    return (F.least(width, height) >= 400) & (F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\w+)"))) >= 5)


def grounded(value: Column, page: Column) -> Column:
    """Whether a value is on the page: whole, or, of three words or more, most of those over three letters. Very short values pass."""
    v, p = folded(value), folded(page)
    words = F.filter(F.split(F.lower(value), r"[^a-z0-9]+"), lambda w: w != "")
    long_ = F.filter(words, lambda w: F.length(w) > 3)
    hits = F.size(F.filter(long_, lambda w: p.contains(w)))
    most = (F.size(words) >= 3) & (F.size(long_) > 0) & (hits >= 2) & (hits >= F.size(long_) * 0.6)
    return (F.length(v) < 3) | p.contains(v) | most


def conflicts(path: Column, value: Column, fields: Column) -> Column:
    """A birth date with an issue date's digits, or an identity number with an enrolment's. fields: a map of path to value."""
    low, own = F.lower(path), _digits(value)
    same = lambda k: _digits(fields[k]) == own
    birth = (low.endswith("dob") | low.contains("date_of_birth")) & reduce(lambda a, b: a | b, (same(k) for k in RIVALS))
    return (own != "") & (birth | (low.contains("aadhaar_number") & same("enrollment_number")))


def verdicts(fields: DataFrame, wide: bool = False) -> DataFrame:
    """Fields (doc_id, path, value, page_text, legible, digital, fields) with status: exact, verified, unchecked or flagged. The first rule that applies decides.

    wide: values are looked for on pages with letters of other widths and forms as plain ones.
    """
    form = nfkc if wide else lambda c: c
    columns = fields.columns
    fields = fields.withColumns({"_value": form(F.col("value")), "_page": form(F.col("page_text"))})
    path, value = F.lower(F.col("path")), F.col("value")
    spaced = path.rlike("phone|mobile|aadhaar")
    shape = ids.format_ok(path, F.when(spaced, F.trim(value)).otherwise(F.regexp_replace(value, r"\s", "")))
    is12, ispan = path.rlike("aadhaar|aadhar|uid"), path.contains("pan_number") | path.endswith("pan")
    structure = F.when(is12, ids.id12(value)["valid"]).when(ispan, ids.pan(value)["valid"])
    status = (
        F.when(value.rlike(PLACEHOLDER) | ~F.col("legible"), "flagged").when(~F.coalesce(shape, F.lit(True)), "flagged")
        .when(F.coalesce(conflicts(path, value, F.col("fields")), F.lit(False)), "flagged").when(~F.coalesce(structure, F.lit(True)), "flagged")
        .when(F.col("digital"), "exact").when(path.rlike("|".join(REWRITTEN)), "unchecked").when(grounded(F.col("_value"), F.col("_page")), "verified").otherwise("flagged")
    )
    return fields.where(F.trim(value) != "").select(*columns, status.alias("status"))


def verification(verdict: DataFrame, documents: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Per document: counts of statuses, confidence, and whether it needs review. legible comes with the verdicts; documents (key, legible) adds those without a field."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("exact", "verified", "unchecked", "flagged")}
    out = verdict.groupBy(key).agg(F.bool_and("legible").alias("legible"), F.count("*").alias("fields"), *n.values())
    if documents is not None:
        out = documents.select(key, "legible").join(out.drop("legible"), key, "left").fillna(0, ["fields", *n])
    checked = F.col("exact") + F.col("verified") + F.col("flagged")
    score = F.when(~F.col("legible"), 0.1).when(F.col("fields") == 0, 0.3).when(checked == 0, 0.5).otherwise(F.round((F.col("exact") + F.col("verified")) / checked, 2))
    return out.withColumns({"confidence": score, "needs_review": (F.col("flagged") > 0) | ~F.col("legible") | (F.col("fields") == 0)})


# Words of file names by type, in order, and what they are worth.
FILE_WORDS = [
    ("PAN", ["pan"], 0.99),
    ("AADHAAR", ["aadhaar", "aadhar"], 0.99),
    ("PASSPORT", ["passport"], 0.99),
    ("DRIVING_LICENSE", ["driving", "license", "licence"], 0.99),
    ("RESUME", ["resume", "cv"], 0.99),
    ("STOCK_STATEMENT", ["stock", "sales", "sst", "inventory", "st-", "sas", "lifecare", "medica"], 0.95),
    ("INVOICE", ["invoice", "bill", "receipt", "voucher"], 0.95),
]
COMPACT = ["stocksummary", "stocksalesanalysis", "stockstatement", "stockstatment", "stockandsales", "stocksales", "stockclosing", "stockposition", "itemwisestock", "dailystock", "stockreport", "salesanalysis", "stockanalysis", "closingstock", "openingstock", "salesstatement", "stockledger", "itemwisestocksummary"]
IDENTITY = ["PAN", "AADHAAR", "PASSPORT", "DRIVING_LICENSE"]
PROSE = [*IDENTITY, "RESUME", "CV", "CURRICULUM_VITAE", "VISITING_CARD", "PRESCRIPTION", "FORM", "REGISTRATION_FORM", "HOSPITAL_DOCUMENTS", "UNKNOWN"]
TABULAR = ["STOCK_STATEMENT", "STOCK_SUMMARY", "STOCK_SALES_REPORT", "SALES_SUMMARY", "LEDGER", "SPREADSHEET"]


def _has(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def classified(name: Column, requested: Column) -> Column:
    """A struct (document_type, confidence) by extension, then the request, then words of the file name."""
    low, ext = F.lower(name), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    made = lambda kind, c: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("document_type"), F.lit(c).alias("confidence"))
    out = F.when(ext.isin("xlsx", "xls", "csv", "txt", "text", "log"), made("SPREADSHEET", 1.0)).when(ext.isin("docx", "doc"), made("RESUME", 1.0))
    asked = F.upper(F.trim(F.coalesce(F.nullif(requested, F.lit("")), F.lit("AUTO"))))
    out = out.when(~asked.isin("AUTO", "UNKNOWN"), made(asked, 1.0))
    for kind, words, worth in FILE_WORDS:
        test = _has(low, words)
        if kind == "STOCK_STATEMENT":
            test = test | _has(folded(name), COMPACT)
        out = out.when(test, made(kind, worth))
    return out.otherwise(made("UNKNOWN", 0.0))


def route(document_type: Column, source: Column, heavy: Column, perspective: Column) -> Column:
    """The pipeline of a profile: prose never takes a table's."""
    return (
        F.when(document_type.isin(*IDENTITY), "ID_CARD_PIPELINE").when(document_type.isin(*PROSE), "GENERAL_VLM_PIPELINE")
        .when((source == "DIGITAL_PDF") & heavy, "NATIVE_PDF_TABLE_PIPELINE").when(perspective & heavy, "PERSPECTIVE_TABLE_PIPELINE")
        .when((source == "SCREEN_PHOTO") & heavy, "SCREEN_PHOTO_TABLE_PIPELINE").when(heavy | document_type.isin(*TABULAR), "COORDINATE_TABLE_PIPELINE").otherwise("GENERAL_VLM_PIPELINE")
    )


def upload_error(name: Column, size: Column, head: Column, extensions: list[str], limit: int = 50 << 20) -> Column:
    """Why an upload is refused (extension, size, content), else null. head: the first bytes."""
    # First bytes of formats, in hex.
    magic = {"pdf": "25504446", "png": "89504E47", "jpg": "FFD8FF", "jpeg": "FFD8FF", "bmp": "424D", "tiff": "49492A00|4D4D002A", "webp": "52494646", "xlsx": "504B", "docx": "504B", "xls": "D0CF11E0", "doc": "D0CF11E0"}
    ext, own = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)), F.hex(head)
    wrong = F.lit(False)
    for kind, starts in magic.items():
        wrong = wrong | ((ext == kind) & ~own.rlike(f"^({starts})"))
    return F.when(~ext.isin(*extensions), "extension").when(size > limit, "size").when(wrong, "content")
