"""Small text expressions shared by all operators."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a trim removes, and the line ends.
TRIMMED = " \t\n\r\0\x0b"
LINE_END = r"\r\n|\r|\n"
# An entity: a decimal or hexadecimal number, or one of the names of HTML 4.
_ENTITY = "&(?:#0*+[1-9][0-9]{0,6}|#[xX]0*+[1-9a-fA-F][0-9a-fA-F]{0,5}|[a-zA-Z][a-zA-Z0-9]*+);"
_NAMED = json.dumps({name: chr(code) for name, code in name2codepoint.items()})


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def is_blank(text: Column) -> Column:
    return trimmed(text) == ""


def is_empty(text: Column) -> Column:
    """The text counts as not given: empty, or the single digit 0."""
    return text.isin("", "0")


def lines(text: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(text, LINE_END), trimmed), lambda row: row != "")


def _character(entity: Column) -> Column:
    """What an entity stands for; unknown names and numbers that are no printable character stay as written."""
    digits = F.regexp_extract(entity, "^&#[xX]?0*(.*);$", 1)
    code = F.when(F.regexp_like(entity, F.lit("^&#[xX]")), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
    allowed = code.isin(9, 10, 13) | code.between(0x20, 0x7E) | code.between(0xA0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    by_number = F.when(allowed, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)
    by_name = F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), F.regexp_extract(entity, "^&(.*);$", 1))
    return F.when(F.startswith(entity, F.lit("&#")), by_number).otherwise(F.coalesce(by_name, entity))


def entity_decode(text: Column) -> Column:
    """Decode numeric and named markup entities, each once."""
    return replace_each(text, _ENTITY, _character)


def quoted(text: Column) -> Column:
    """Quote a host or domain for use inside a pattern."""
    return F.concat(F.lit(r"\Q"), text, F.lit(r"\E"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def replace_each(text: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """Replace every match by an expression of the match.

    ``pattern`` must have no group and never match the empty string.
    """

    def replaced(whole: Column) -> Column:
        pieces = F.zip_with(
            F.split(whole, pattern, -1),
            F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), body),
            lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))),
        )
        return F.when(F.regexp_like(whole, F.lit(pattern)), F.array_join(pieces, "")).otherwise(whole)

    return bind(text, replaced)
