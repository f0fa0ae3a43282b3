"""Field templates by document type, and the type that a document's text shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.functions.cells import present

# The fields of each type, in order.
_INVOICE = ["invoice_number", "invoice_date", "vendor_name", "gst_number", "buyer", "subtotal", "tax", "grand_total", "currency", "line_items"]
_STOCK = ["distributor_name", "company_name", "statement_period", "summary_totals", "columns", "items"]
TEMPLATES = {
    "PAN": ["name", "father_name", "dob", "pan_number"],
    "AADHAAR": ["name", "guardian_name", "dob", "gender", "aadhaar_number", "enrollment_number", "enrollment_date", "mobile", "address", "district", "state", "pin_code"],
    "PASSPORT": ["passport_number", "surname", "given_name", "nationality", "dob", "gender", "place_of_birth", "date_of_issue", "date_of_expiry"],
    "DRIVING_LICENSE": ["license_number", "name", "dob", "address", "issue_date", "expiry_date"],
    "VISITING_CARD": ["name", "designation", "company", "phone", "email", "website", "address", "city", "state", "pin_code"],
    "INVOICE": _INVOICE,
    "BILL": _INVOICE,
    "STOCK_STATEMENT": _STOCK,
    "STOCK_SUMMARY": _STOCK,
    "STOCK_SALES_REPORT": _STOCK,
    "SALES_SUMMARY": _STOCK,
    "LEDGER": ["account_name", "statement_period", "opening_balance", "closing_balance", "columns", "transactions"],
    "RECEIPT": ["receipt_number", "receipt_date", "received_from", "amount", "payment_mode", "line_items"],
    "PRESCRIPTION": ["clinic_or_hospital", "date", "patient_name", "age", "medications", "advice", "doctor_signature"],
    "FORM": ["form_title", "applicant_name", "registration_id", "date", "details"],
    "RESUME": ["candidate_name", "contact_info", "professional_summary", "skills", "work_experience", "education", "certifications", "projects"],
    "SPREADSHEET": ["sheet_title", "columns", "rows"],
    "UNKNOWN": ["title", "description", "key_points"],
}
# Other names of types.
ALIASES = {"PAN_CARD": "PAN", "AADHAAR_CARD": "AADHAAR", "VISITING CARD": "VISITING_CARD", "CV": "RESUME", "CURRICULUM_VITAE": "RESUME", "EXCEL": "SPREADSHEET", "TABLE": "SPREADSHEET", "REGISTRATION_FORM": "FORM", "HOSPITAL_DOCUMENTS": "FORM"}


def canonical_type(name: Column) -> Column:
    """A type's name, upper-cased, by its main name; blank is UNKNOWN."""
    own = F.coalesce(F.nullif(F.upper(F.trim(name)), F.lit("")), F.lit("UNKNOWN"))
    other = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.element_at(other, own), own)


def template(document_type: Column) -> Column:
    """The fields of a type in order; those of UNKNOWN where it has none of its own."""
    every = F.create_map(*(x for t, names in TEMPLATES.items() for x in (F.lit(t), F.array(*(F.lit(n) for n in names)))))
    return F.coalesce(F.element_at(every, canonical_type(document_type)), F.element_at(every, F.lit("UNKNOWN")))


def templated(fields: DataFrame, key: str, document_type: str = "document_type") -> DataFrame:
    """(key, document_type, path, value, confidence, ord, review) of fields (key, document_type, path, value, confidence, ord).

    Fields of the type's template come first, in its order, then others as seen. Absent values go. A field
    without confidence has 0.95. Review: under 0.60, or a value that the loose rules refuse.
    """
    names = template(F.col(document_type))
    rows = fields.withColumn("value", present(F.trim("value"))).where("value is not null and value <> ''")
    place = F.array_position(names, F.col("path"))
    rows = rows.withColumns({"confidence": F.coalesce("confidence", F.lit(0.95)), "ord": F.when(place > 0, place - 1).otherwise(F.col("ord") + F.size(names)).cast("long"), "document_type": canonical_type(F.col(document_type))})
    return rows.withColumn("review", (F.col("confidence") < 0.6) | ~ids.loose_ok(F.col("path"), F.col("value"))).select(key, "document_type", "path", "value", "confidence", "ord", "review")


def _any(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def refined_type(document_type: Column, text: Column, legible: Column, tables: Column) -> Column:
    """A struct (document_type, confidence): what the text of a legible page shows where the type is UNKNOWN, INVOICE or FORM; else the type, with no confidence."""
    t = F.upper(F.coalesce(text, F.lit("")))
    # Words that show a type, in the order in which they are tried.
    stock = _any(t, "STOCK AND SALES", "STOCK & SALES", "STOCK STATEMENT", "STOCK STATMENT", "OP. QTY", "BAL. QTY", "PUR. QTY", "BAL.VAL", "DUMP QTY", "STOCK-VALUE", "SALES-VALUE")
    moved = _any(t, "PURCHASE", "SALES", "STOCK", "RECEIPT", "ISSUE")
    schooled = _any(t, "COURSE WORK", "TRAINING", "SKILLS", "EXPERIENCE", "PROJECTS", "DECLARATION", "PROFESSIONAL SUMMARY")
    shown = [
        ("STOCK_STATEMENT", 0.99, stock | t.rlike(r"STOCK\s+STATE?MENT") | (t.contains("OPENING") & t.contains("CLOSING") & moved)),
        ("PAN", 0.99, _any(t, "INCOME TAX", "PERMANENT ACCOUNT NUMBER") | t.rlike(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b")),
        ("AADHAAR", 0.99, _any(t, "UIDAI", "UNIQUE IDENTIFICATION", "AADHAAR")),
        ("PASSPORT", 0.99, t.contains("PASSPORT")),
        ("DRIVING_LICENSE", 0.99, _any(t, "DRIVING LICENCE", "DRIVING LICENSE")),
        ("RESUME", 0.99, _any(t, "RESUME", "CURRICULUM VITAE") | (t.contains("EDUCATION") & schooled)),
        ("INVOICE", 0.99, _any(t, "TAX INVOICE", "BILL OF SUPPLY", "RETAIL INVOICE", "CASH MEMO", "GSTIN")),
        ("SPREADSHEET", 0.99, _any(t, "EXCEL", "WORKBOOK", "SHEET1", "AUTOSAVE", "CLUSTER", "DATA ANALYSIS") | (t.contains("COLUMN") & t.contains("ROW")) | ((tables > 0) & ~_any(t, "EDUCATION", "DECLARATION"))),
        ("FORM", 0.98, _any(t, "MEDICAL CARE", "HOSPITAL", "BROCHURE", "HEALTH SERVICES", "FORM", "APPLICATION")),
    ]
    as_is = F.struct(document_type.alias("document_type"), F.lit(None).cast("double").alias("confidence"))
    open_ = legible & document_type.isin("UNKNOWN", "INVOICE", "FORM")
    chosen = F.coalesce(*(F.when(test, F.struct(F.lit(kind).alias("document_type"), F.lit(c).alias("confidence"))) for kind, c, test in shown))
    return F.coalesce(F.when(open_, chosen), as_is)
