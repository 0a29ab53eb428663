"""Masking of tax identities in texts and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identity formats and what takes their place.
GSTIN = "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}"
PAN = "[A-Z]{5}[0-9]{4}[A-Z]{1}"
AADHAAR = r"^[2-9]{1}[0-9]{3}\s[0-9]{4}\s[0-9]{4}$"
PAN_MASK, AADHAAR_MASK, GSTIN_MASK = "[PAN_MASKED]", "[AADHAAR_MASKED]", "[GSTIN_MASKED]"


def mask_identities(text: Column, for_logs: bool = False) -> Column:
    """PAN and Aadhaar masked; a GSTIN stays in text, with the PAN it contains, and is masked in logs."""
    # matched first, a GSTIN is put back whole, so that only a PAN outside of one is left to mask
    if for_logs:
        text = F.regexp_replace(text, GSTIN, GSTIN_MASK)
        text = F.regexp_replace(text, PAN, PAN_MASK)
    else:
        text = F.regexp_replace(text, rf"(?<![0-9]{{2}}){PAN}|(?<=[0-9]{{2}}){PAN}(?![1-9A-Z]Z[0-9A-Z])", PAN_MASK)
    return F.regexp_replace(text, AADHAAR, AADHAAR_MASK)


def count_identities(text: Column) -> Column:
    """How many GSTIN, and how many PAN outside of one, a text holds."""
    gstin = F.regexp_count(text, F.lit(GSTIN))
    return F.struct(gstin.alias("gstin"), F.regexp_count(F.regexp_replace(text, GSTIN, " "), F.lit(PAN)).alias("pan"))
