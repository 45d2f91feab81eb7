"""Text columns: codes parsed from course names, documents, person names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Naming patterns of courses and user names.
PROGRAM_SUFFIX = r"\(([0-9]+)(?:_PRY_[0-9]+)?\)\s*\z"
REGION_CODE = r"_R_([0-9]+)"
CENTER_CODE = r"_C_([0-9]+)"
MODALITY_LETTER = r"^[0-9]*P_[0-9]+_([A-Za-z]+)_"
VERSION = r"^[0-9]*P_[0-9]+_[A-Za-z]+_([0-9]+)"
SHORT_PROGRAM_CODE = r"^P_([0-9]+)_"
INTEGRATED = r"^(P_[0-9]+_|[0-9]+P_[0-9]+_)"
INTEGRATED_STRICT = r"^P_[0-9]+_.*_R_[0-9]+_C_[0-9]+"
DOCUMENT_KINDS = ("cc", "dni", "ce", "ppt")
DOCUMENT_KINDS_WITH_TI = ("cc", "dni", "ce", "ppt", "ti")


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of the group, NULL (not '') when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def program_code(fullname: Column) -> Column:
    return extract(fullname, PROGRAM_SUFFIX)


def program_name(fullname: Column) -> Column:
    return F.trim(F.regexp_replace(fullname, r"\s*" + PROGRAM_SUFFIX, ""))


def region_code(shortname: Column) -> Column:
    return extract(shortname, REGION_CODE)


def center_code(shortname: Column) -> Column:
    return extract(shortname, CENTER_CODE)


def modality_letter(shortname: Column) -> Column:
    return extract(shortname, MODALITY_LETTER)


def version(shortname: Column) -> Column:
    return extract(shortname, VERSION)


def short_program_code(shortname: Column) -> Column:
    return extract(shortname, SHORT_PROGRAM_CODE)


def full_name(first: Column, last: Column) -> Column:
    """First and last name with one blank between; a missing part counts as ''."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def _suffix(kinds: tuple[str, ...]) -> str:
    return "(" + "|".join(kinds) + r")\z"


def document_type(username: Column, kinds: tuple[str, ...]) -> Column:
    return F.coalesce(F.upper(extract(F.lower(username), _suffix(kinds))), F.lit("No definido"))


def document_number(username: Column, kinds: tuple[str, ...]) -> Column:
    return F.regexp_replace(username, "(?i)" + _suffix(kinds), "")


def blank_to(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def or_undefined(text: Column) -> Column:
    return F.coalesce(text, F.lit("No definido"))
