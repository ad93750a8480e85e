"""Patterns and character sets (Java regex). Lengths and positions are in code points throughout the package."""

# What each detector looks for.
DETECTORS = {
    "credit_card": r"(?:\d[ -]*?){13,19}",
    "passport_rf": r"[0-9]{4}\s?[0-9]{6}",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone_rf": r"(\+7|8)[\s-]?[(]?\d{3}[)]?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}",
    "date": r"\b\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}\b",
    "inn": r"\b\d{10,12}\b",
    "snils": r"\b\d{3}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{2}\b",
    "kpp": r"\b\d{4}[\s-]?\d{2}[\s-]?\d{3}\b",
}

# Three definitions of "Cyrillic" and one of "Latin"; which applies depends on the operator.
CYRILLIC_BLOCK = r"[\x{0400}-\x{0481}\x{048A}-\x{04FF}]"  # letters of the block
CYRILLIC_ALPHABET = r"[\x{0410}-\x{044F}\x{0401}\x{0451}]"
CYRILLIC_WIDE = r"[\x{0400}-\x{052F}]"
LATIN = r"[A-Za-z]"

# Latin letters and the Cyrillic ones that look like them, position by position.
LOOKALIKE_LATIN = "ABCEHKMOPTXaceopxy"
LOOKALIKE_CYRILLIC = "АВСЕНКМОРТХасеорху"

TRIM = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
TRIM_END = r"[\s\p{Z}]+$"
TRIM_START = r"^[\s\p{Z}]+"
LINE_END = r"\r\n|\n|\r"
