"""Expressions over raw HTML text. Patterns are linear-time: no nested unbounded backtracking."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMENT = r"<!--.*?(?:-->|\z)"
SCRIPT = r"<script\b.*?(?:</script[^>]*>|\z)"
STYLE = r"<style\b.*?(?:</style[^>]*>|\z)"
NOSCRIPT = r"<noscript\b.*?(?:</noscript[^>]*>|\z)"
# a tag whose quoted values may hold '>', then a tag with unbalanced quotes, a declaration, text
TAG = r"""</?[a-z][^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+>"""
TOKEN = f"(?is){COMMENT}|{SCRIPT}|{STYLE}|{TAG}|</?[a-z][^>]*>|<[!?/][^>]*>|<?[^<]+|<"
TAG_NAME = r"^</?([a-zA-Z][^\s/>]*)"
ATTRIBUTE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""

# Fixed value: elements without content.
VOID_TAGS = (
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image",
    "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source",
    "spacer", "track", "wbr",
)

# the named entities of HTML 4 (and ``apos``), from the standard library's table
NAMED_ENTITIES = json.dumps({**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"})


def strip_scripts(html: Column) -> Column:
    """Remove comments, scripts, styles and noscript blocks; an unclosed one runs to the end."""
    return F.regexp_replace(html, f"(?is){COMMENT}|{SCRIPT}|{STYLE}|{NOSCRIPT}", "")


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for numbers that are none."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    padded = F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")
    return F.decode(F.unhex(padded), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Decode named and numeric entities in one pass, so a decoded ``&amp;`` is not read again."""
    # one constant: the optimizer folds it into a single map literal
    named = F.from_json(F.lit(NAMED_ENTITIES), "MAP<STRING, STRING>")

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]*);$", 1)
        dec = F.regexp_extract(piece, r"^&#([0-9]{1,9});$", 1)
        hexa = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]{1,7});$", 1)
        return (
            F.when(~piece.startswith("&"), piece)
            .when(dec != "", _character(dec.try_cast("bigint")))
            .when(hexa != "", _character(F.conv(hexa, 16, 10).try_cast("bigint")))
            .otherwise(F.coalesce(F.try_element_at(named, name), piece))
        )

    pieces = F.regexp_extract_all(text, F.lit(r"&#?[A-Za-z0-9]+;|&|[^&]+"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, TAG_NAME, 1))


def token_kind(token: Column) -> Column:
    """text, open, close, void, skip (comments, scripts, declarations) or eof (the end mark)."""
    name = tag_name(token)
    is_tag = token.rlike(r"^</?[a-zA-Z]")
    return (
        F.when(token == "", "eof")
        .when(token.startswith("<!") | token.startswith("<?") | token.rlike(r"(?i)^<(script|style)\b"), "skip")
        .when(is_tag & token.endswith(">") & token.startswith("</"), "close")
        .when(is_tag & token.endswith(">") & (name.isin(*VOID_TAGS) | token.endswith("/>")), "void")
        .when(is_tag & token.endswith(">"), "open")
        .when(token.startswith("</"), "skip")
        .otherwise("text")
    )


def attribute_list(token: Column) -> Column:
    """Attributes of a start tag as an array of (k, v), in source order, duplicates kept."""
    inner = F.regexp_replace(token, r"^<[a-zA-Z][^\s/>]*|/?>$", "")
    found = F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(0))

    def pair(item: Column) -> Column:
        value = F.regexp_extract(item, r"""(?s)^[^=]*=\s*["']?(.*?)["']?$""", 1)
        return F.struct(F.lower(F.regexp_extract(item, r"^([^\s=]+)", 1)).alias("k"), value.alias("v"))

    def decoded(a: Column) -> Column:
        return F.struct(a.k.alias("k"), decode_entities(a.v).alias("v"))

    none = F.array().cast("array<struct<k:string,v:string>>")
    return F.when(inner.rlike(r"\S"), F.transform(F.transform(found, pair), decoded)).otherwise(none)


def attribute(attrs: Column, name: Column | str) -> Column:
    """The last value given for an attribute, NULL when it is absent."""
    key = F.lit(name) if isinstance(name, str) else name
    return F.try_element_at(F.filter(attrs, lambda a: a.k == key), F.lit(-1)).v


def attribute_map(attrs: Column) -> Column:
    """Attributes as a map; the last duplicate wins."""
    keys = F.array_distinct(F.transform(attrs, lambda a: a.k))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: attribute(attrs, k)))


def class_list(attrs: Column) -> Column:
    """Class tokens of a node."""
    return F.filter(F.split(F.coalesce(attribute(attrs, "class"), F.lit("")), r"\s+"), lambda c: c != "")
