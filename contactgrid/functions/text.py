"""Text helpers: Unicode white space, entity decoding, snippets, sanitizing, CSV cells."""

from __future__ import annotations

import html.entities
import json
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode-aware text tools see it; the default regex class \s is ASCII only.
SPACE = (
    r"\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARACTERS = "".join(
    chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                     0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# Windows-1252 meaning of the character references 128..159 (fixed values of the HTML standard)
CP1252_REFERENCES = {
    128: 0x20AC, 130: 0x201A, 131: 0x0192, 132: 0x201E, 133: 0x2026, 134: 0x2020, 135: 0x2021,
    136: 0x02C6, 137: 0x2030, 138: 0x0160, 139: 0x2039, 140: 0x0152, 142: 0x017D, 145: 0x2018,
    146: 0x2019, 147: 0x201C, 148: 0x201D, 149: 0x2022, 150: 0x2013, 151: 0x2014, 152: 0x02DC,
    153: 0x2122, 154: 0x0161, 155: 0x203A, 156: 0x0153, 158: 0x017E, 159: 0x0178,
}


def strip_space(value: Column) -> Column:
    """Trim Unicode white space on both sides (byte-level trim, no regex)."""
    return F.btrim(value, F.lit(SPACE_CHARACTERS))


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.length(value)


def collapse_space(value: Column) -> Column:
    """Runs of white space become one blank, no blanks at the ends."""
    return F.trim(F.regexp_replace(value, rf"[{SPACE}]++", " "))


def first_chars(value: Column, limit: int | None) -> Column:
    """The first `limit` characters; all of them without a limit."""
    return value if limit is None else F.substring(value, 1, limit)


def first_items(values: Column, limit: int | None) -> Column:
    """The first `limit` elements; all of them without a limit."""
    return values if limit is None else F.slice(values, 1, limit)


def sanitize_text(value: Column, max_length: int | None = None) -> Column:
    """Control characters to blanks, blanks collapsed, empty text to null."""
    cleaned = collapse_space(F.regexp_replace(value, r"[\x00-\x1f\x7f-\x9f]++", " "))
    return F.when(cleaned != "", first_chars(cleaned, max_length))


def csv_cell(value: Column) -> Column:
    """Null to '', control characters to blanks, spreadsheet formulas defused with a quote."""
    text = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x1f]", " ")
    return F.when(text.rlike(rf"^[{SPACE}]*+[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def evidence_snippet(text: Column, target: Column, max_length: int) -> Column:
    """Bounded window of `text` around the first occurrence of `target`."""
    at = F.instr(text, target) - 1
    size = F.length(target)
    margin = F.greatest(F.lit(0), F.floor((F.lit(max_length) - size) / 2)).cast("int")
    start = F.greatest(F.lit(0), at - margin)
    window = F.when(at < 0, F.substring(text, 1, max_length)).otherwise(
        F.substring(text, start + 1, at + size + margin - start)
    )
    return F.substring(collapse_space(window), 1, max_length)


@lru_cache(maxsize=1)
def _entity_tables() -> tuple[str, str]:
    """(JSON map of all named references, pattern of those valid without a semicolon)."""
    names = html.entities.html5
    bare = sorted((n for n in names if not n.endswith(";")), key=len, reverse=True)
    return json.dumps(names), "^(" + "|".join(bare) + ")"


def _code_point(number: Column) -> Column:
    """Character for a numeric reference, with the HTML rules for bad numbers."""
    fixed = F.create_map(*[F.lit(x) for pair in CP1252_REFERENCES.items() for x in pair])
    usable = F.coalesce(
        F.when(number.between(128, 159), F.element_at(fixed, number.cast("int"))), number)
    as_text = F.decode(F.unhex(F.lpad(F.hex(usable), 8, "0")), "UTF-32")
    bad = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    dropped = (
        number.between(1, 8) | (number == 11) | number.between(14, 31)
        | (number == 127) | number.between(0xFDD0, 0xFDEF)
        | (((number % 65536) == 65534) | ((number % 65536) == 65535))
    )
    return F.when(bad, F.lit("\ufffd")).when(dropped, F.lit("")).otherwise(as_text)


def _decode_piece(piece: Column, in_attribute: bool) -> Column:
    """Decode the reference at the start of a piece of text that followed an ampersand."""
    names_json, bare_pattern = _entity_tables()
    names = F.from_json(F.lit(names_json), "map<string,string>")
    decimal = F.regexp_extract(piece, r"^#([0-9]+)", 1)
    hexadecimal = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+)", 1)
    number_length = F.length(F.regexp_extract(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0))
    hex_digits = F.regexp_replace(hexadecimal, "^0+(?=.)", "")
    number = F.when(decimal != "", decimal.try_cast("bigint")).when(
        F.length(hex_digits) <= 8, F.conv(hex_digits, 16, 10).cast("bigint"))
    name = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};", 0)
    prefix = F.regexp_extract(piece, bare_pattern, 1)
    rest = F.substr(piece, F.length(prefix) + 1)
    keep_bare = rest.rlike("^[=a-zA-Z0-9]") if in_attribute else F.lit(False)

    def after(entity: str) -> Column:
        return F.substr(piece, F.lit(len(entity) + 1))

    # the frequent names first: the full map is searched linearly
    decoded = F.when(piece.startswith("amp;"), F.concat(F.lit("&"), after("amp;")))
    for entity, text in (("nbsp;", "\xa0"), ("lt;", "<"), ("gt;", ">"), ("quot;", '"'),
                         ("copy;", "\xa9"), ("middot;", "\xb7")):
        decoded = decoded.when(piece.startswith(entity), F.concat(F.lit(text), after(entity)))
    return (
        decoded.when(
            (decimal != "") | (hexadecimal != ""),
            F.concat(_code_point(number), F.substr(piece, number_length + 1)),
        )
        .when(
            (name != "") & F.map_contains_key(names, name),
            F.concat(F.element_at(names, name), F.substr(piece, F.length(name) + 1)),
        )
        .when((prefix != "") & ~keep_bare, F.concat(F.element_at(names, prefix), rest))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def decode_entities(value: Column, in_attribute: bool = False) -> Column:
    """Decode character references once (`&amp;lt;` gives `&lt;`); text without `&` is untouched."""
    pieces = F.transform(
        F.split(value, "&"),
        lambda piece, at: F.when(at == 0, piece).otherwise(_decode_piece(piece, in_attribute)),
    )
    return F.when(value.contains("&"), F.array_join(pieces, "")).otherwise(value)


def short_digest(value: Column) -> Column:
    """Stable 16-hex reference that does not reveal the value."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, 16)
