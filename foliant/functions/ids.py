"""Identity numbers and field formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dihedral(a: int, b: int) -> int:
    """The product of two symmetries of a pentagon: 0-4 turn, 5-9 turn and flip."""
    turn = (a + b) % 5 if a < 5 else (a - b) % 5
    return turn + 5 * ((a < 5) != (b < 5))


#: Fixed value: the check's permutation of digits.
PERMUTATION = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def powers() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([PERMUTATION[x] for x in rows[-1]])
    return rows


def verhoeff(digits: Column) -> Column:
    """Whether a string of digits ends in its check digit."""
    table = F.array(*(F.lit(dihedral(a, b)) for a in range(10) for b in range(10)))
    moved = F.array(*(F.lit(x) for row in powers() for x in row))
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.get(moved, (i % 8) * 10 + d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda c, d: F.get(table, c * 10 + d)) == 0


def id12(value: Column) -> Column:
    """A struct (valid, reason, normalised) for twelve-digit identity numbers, masked ones included."""
    raw = F.regexp_replace(F.coalesce(F.trim(value), F.lit("")), r"[\s\-]", "")
    masks = F.length(F.regexp_replace(raw, "[^xX*•]", ""))
    masked = (F.length(raw) == 12) & (masks >= 4) & raw.rlike("^[xX*•0-9]+$")
    shaped = raw.rlike("^[0-9]{12}$")
    good = shaped & ~raw.rlike("^[01]") & F.when(shaped, verhoeff(raw)).otherwise(False)
    reason = F.when(masked, "masked").when(~shaped, "format").when(~good, "checksum").otherwise("ok")
    grouped = F.concat_ws(" ", F.substring(raw, 1, 4), F.substring(raw, 5, 4), F.substring(raw, 9, 4))
    return F.struct((masked | good).alias("valid"), reason.alias("reason"), F.when(good | masked, grouped).otherwise(F.trim(value)).alias("normalised"))


# Holder types by the fourth letter.
HOLDERS = {"P": "Individual", "C": "Company", "H": "Hindu Undivided Family", "F": "Firm / Limited Liability Partnership", "A": "Association of Persons", "T": "Trust", "B": "Body of Individuals", "L": "Local Authority", "J": "Artificial Juridical Person", "G": "Government", "K": "Krish (Trust under Krishi)"}


def pan(value: Column) -> Column:
    """A struct (valid, reason, holder) for tax numbers of five letters, four digits and a letter."""
    raw = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s", ""))
    shaped = raw.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")
    holder = F.create_map(*(F.lit(x) for kv in HOLDERS.items() for x in kv))[F.substring(raw, 4, 1)]
    reason = F.when(~shaped, "format").when(holder.isNull(), "holder_type").otherwise("ok")
    return F.struct((reason == "ok").alias("valid"), reason.alias("reason"), F.when(reason == "ok", holder).alias("holder"))


_DATE = r"^[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
# Shapes of fields by a part of their path, first match first.
FORMATS = [
    ("pan_number", r"^[A-Z]{5}[0-9]{4}[A-Z]$"),
    ("aadhaar_number", r"(?i)^([0-9]{4}\s?[0-9]{4}\s?[0-9]{4}|[X*]{4}\s?[X*]{4}\s?[0-9]{4})$"),
    ("gstin", r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"),
    ("ifsc", r"^[A-Z]{4}0[A-Z0-9]{6}$"),
    ("pin_code", r"^[0-9]{6}$"),
    ("email", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"),
    ("phone", r"^[+0-9][0-9\s\-()]{7,19}$"),
    ("mobile", r"^[+0-9][0-9\s\-()]{7,19}$"),
    ("dob", _DATE),
    ("date_of_birth", _DATE),
]


def format_ok(path: Column, value: Column) -> Column:
    """Whether a value has its field's shape; null where the field has none."""
    low, out = F.lower(path), None
    for key, pattern in FORMATS:
        out = F.when(low.contains(key), value.rlike(pattern)) if out is None else out.when(low.contains(key), value.rlike(pattern))
    return out


def loose_ok(path: Column, value: Column) -> Column:
    """The envelope's looser rules. A null value is fine."""
    low, text = F.lower(path), value.cast("string")
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    upper = F.upper(F.trim(text))
    day = F.regexp_extract_all(text, F.lit(r"([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4})"))
    named = F.trim(text).rlike(r"(?i)^[0-9]{1,2}-(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-[0-9]{4}$")
    rule = (
        F.when(low.contains("pan") & ~low.contains("company"), upper.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"))
        .when(low.contains("aadhaar"), digits == 12)
        .when(low.contains("gst"), upper.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"))
        .when(low.contains("email"), F.trim(text).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"))
        .when(low.rlike("phone|mobile|contact"), digits.between(10, 12))
        .when(low.rlike("pin|postal"), digits == 6)
        .when(low.rlike("date|dob"), (F.size(day) > 0) | named)
        .otherwise(True)
    )
    return F.when(value.isNull(), True).otherwise(rule)
