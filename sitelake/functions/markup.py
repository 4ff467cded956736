"""Markup as tokens and tags, with regular expressions only.

Supported grammar: attributes are separated by white space or slashes, or follow a closing quote; values are quoted, or
unquoted without quotes, spaces and ``>``. Quotes count only after ``=``. A tag or a value that is not closed goes on to the end of the text,
so that each character is read a bounded number of times. Scripts, styles, text areas and comments are one token each and
never searched for tags. Joining the tokens of a page gives the page back exactly.

Loops over attributes are possessive: they run in place, so the number of attributes of a tag is not bounded by the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rest of a tag, whose quoted values may hold ">".
_INNER = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+)*+"""
_REST_OF_TAG = rf"{_INNER}(?:>|\z)"
TAG = rf"</?[a-z!?]{_REST_OF_TAG}"


def _whole(name: str) -> str:
    """An element with its content, to the end of the text if it is not closed."""
    return rf"<{name}(?:>|[\s/]{_REST_OF_TAG}).*?(?:</{name}\s*>|\z)"


COMMENT = r"<!--.*?(?:-->|\z)"
RAW = "|".join([COMMENT, _whole("script"), _whole("style"), _whole("textarea")])
NOSCRIPT_TEXT = r"<noscript\b[^>]*>[^<]*</noscript\s*>"
TOKEN = rf"(?is){RAW}|{NOSCRIPT_TEXT}|{TAG}|[^<]++|<"
# For white space: preformatted blocks stay whole as well.
SPACE_TOKEN = rf"(?is){RAW}|{_whole('pre')}|{TAG}|[^<]++|<"
_RAW_BODY = rf"(?is){COMMENT}|(<(?:script|style|textarea)(?:>|[\s/]{_REST_OF_TAG})).*?(?:</(?:script|style|textarea)\s*>|\z)"

_NAME = r"""[^\s=>/"'][^\s=>/]*"""
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""
ATTRIBUTE = rf"(?is)[\s/]*+{_NAME}(?:\s*=\s*{_VALUE})?"


def _up_to(wanted: str) -> str:
    """A start tag up to its first attribute that ``wanted`` matches."""
    other = rf"(?!{wanted})[^\s=>/\"'][^\s=>/]*+(?:\s*+=\s*+{_VALUE})?+"
    return rf"(?is)^<[^\s/>]++(?:[\s/]*+{other})*+[\s/]*+"


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def visible_markup(html: Column) -> Column:
    """The page without comments and without the content of scripts, styles and text areas."""
    return F.regexp_replace(html, _RAW_BODY, "$1")


def tags(markup: Column, name: str | None = None) -> Column:
    """All tags, or the start tags of one name, in page order. One that the text ends in is no tag."""
    start = "</?[a-z!?]" if name is None else rf"<{name}(?=[\s/>])"
    found = F.regexp_extract_all(markup, F.lit(rf"(?is)({start}{_INNER}>)|{start}.*+"), F.lit(1))
    return F.array_remove(found, "")


def is_start(token: Column, name: str) -> Column:
    """The token is a start tag of that name. A comparison of its first letters, as this runs for every token."""
    return F.lower(F.substring(token, 1, len(name) + 2)).isin(*[f"<{name}{end}" for end in "> /\t\n\x0b\f\r"])


def is_start_tag(token: Column) -> Column:
    return F.startswith(token, F.lit("<")) & F.regexp_like(token, F.lit("^<[a-zA-Z]"))


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def attr(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag; empty if it is absent."""
    return _unquoted(F.regexp_extract(tag, rf"{_up_to(rf'{name}\s*+=\s*+{_VALUE}')}{name}\s*+=\s*+({_VALUE})", 1))


def has_attr(tag: Column, name: str) -> Column:
    return F.regexp_like(tag, F.lit(rf"{_up_to(rf'{name}[\s=/>]')}{name}[\s=/>]"))


# --- editing one start tag ------------------------------------------------------------------------


_TAG_END = r"(?<!\s)\s*+/?>$"


def attributes(tag: Column) -> Column:
    """The attributes of a start tag as written, each with the white space before it."""
    inner = F.regexp_replace(F.regexp_replace(tag, r"^<[^\s/>]+", ""), _TAG_END, "")
    return F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(0))


def rebuilt(tag: Column, new_attributes: Column) -> Column:
    """The tag with other attributes."""
    return F.concat(
        F.regexp_extract(tag, r"^<[^\s/>]+", 0),
        F.array_join(new_attributes, ""),
        F.regexp_extract(tag, _TAG_END, 0),
    )


def attribute_name(item: Column) -> Column:
    return F.lower(F.regexp_extract(item, rf"(?is)^[\s/]*({_NAME})", 1))


def attribute_value(item: Column) -> Column:
    return F.regexp_replace(item, rf"""(?s)^[\s/]*{_NAME}(?:\s*=\s*)?["']?|["']$""", "")


def with_value(item: Column, value: Column) -> Column:
    """The attribute with another value, in the quotes it had."""
    head = F.regexp_extract(item, rf"(?is)^[\s/]*{_NAME}\s*=\s*", 0)
    old = F.substr(item, F.length(head) + 1)
    quote = F.when(F.startswith(old, F.lit("'")), "'").otherwise('"')
    return F.concat(head, quote, value, quote)


def new_attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), value, F.lit('"'))


# What stands before the head; a head in a comment or a script is none.
_BEFORE_HEAD = rf"(?is)^(?:[^<]++|{RAW}|<(?!head[\s/>]))*+"
_HEAD = r"<head(?:>|[\s/][^>]*>)"


def head_section(html: Column) -> Column:
    """From ``<head>`` to its end, or to the body; empty if the page has no head."""
    return F.regexp_extract(html, rf"{_BEFORE_HEAD}({_HEAD}.*?(?:</head|<body|\z))", 1)


def has_head(html: Column) -> Column:
    return F.regexp_like(html, F.lit(rf"{_BEFORE_HEAD}<head[\s/>]"))


def at_head_start(html: Column, addition: Column) -> Column:
    """Put text right behind the first ``<head>`` tag."""
    before = F.regexp_extract(html, rf"{_BEFORE_HEAD}{_HEAD}", 0)
    return F.concat(before, addition, F.substr(html, F.length(before) + 1))
