"""Markup handling with regular expressions that run in linear time and constant stack depth.

Possessive quantifiers keep the JVM regex engine iterative, so one hostile page cannot overflow
the stack of an executor or take quadratic time.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactgrid.functions.stages import Getter, Stage
from contactgrid.functions.text import SPACE, collapse_space, decode_entities, first_items

_ATTRIBUTES = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>"""
TAG = rf"</?[a-zA-Z]{_ATTRIBUTES}|<[!?][^>]*+>|<[a-zA-Z/!?][^>]*+\z"

# A start tag is a name and attributes; an attribute has a name and perhaps a value, which may be
# quoted and then hold anything but its quote. A quote that never closes belongs to a name.
_BLANK = r"[\t\n\r\f /]*+"
_EQUALS = r"[\t\n\r\f ]*+=[\t\n\r\f ]*+"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\t\n\r\f >]*+)"""
_NAME = r"[^\t\n\r\f />][^\t\n\r\f /=>]*+"
_ATTRIBUTE = rf"{_NAME}(?:{_EQUALS}{_VALUE})?+"
_REST = rf"{_BLANK}(?:{_ATTRIBUTE}{_BLANK})*+>"
_ENDS = r"(?=[\t\n\r\f />])"
_SOME_VALUE = r"""(?!""|''|[\t\n\r\f >])"""
#: The tags that matter: `a` and `base` with an address, and the end of `a`.
_ADDRESSED = (rf"<(?:a|base){_ENDS}{_BLANK}(?:(?!href{_EQUALS}){_ATTRIBUTE}{_BLANK})*+"
              rf"href{_EQUALS}{_SOME_VALUE}{_VALUE}{_REST}")
#: Value of a tag's last address.
_ADDRESS = (rf"""(?i)^<[a-z]++(?:{_BLANK}(?:href{_EQUALS}("[^"]*+"|'[^']*+'|(?!["'])"""
            rf"[^\t\n\r\f >]*+)|{_ATTRIBUTE}))*+")
#: Characters that mark tags: before and after each one; pages may not bring their own.
OPEN, CLOSE = "\x01", "\x02"


def _markup(*ignored: str) -> str:
    """One pattern for all markup; its first group is a tag that matters.

    Tags are matched whole and in order, so nothing inside a quoted value passes for a tag, an
    ignored element or a comment.
    """
    names = "|".join(ignored)
    return (
        rf"(?is)({_ADDRESSED}|</a{_ENDS}[^>]*+>)|<!--.*?(?:-->|\z)"
        rf"|<({names}){_ENDS}{_REST}.*?(?:</\2{_ENDS}[^>]*+>|\z)"
        rf"|<[a-z][^\t\n\r\f />]*+{_REST}|<[/!?][^>]*+>|<[a-z/!?].*+")


LINK_MARKUP = _markup("script", "style")
TEXT_MARKUP = _markup("script", "style", "template", "noscript")


_IGNORED = ("script", "style", "template", "noscript")
#: Ignored elements and comments, after the other start tags, which are kept whole.
TEXT_NOISE = (rf"(?is)(<(?!(?:{'|'.join(_IGNORED)}){_ENDS})[a-z][^\t\n\r\f />]*+{_REST})"
              rf"|<(?:!--.*?(?:-->|\z)|({'|'.join(_IGNORED)}){_ENDS}{_REST}"
              rf".*?(?:</\2{_ENDS}[^>]*+>|\z))")


def drop_noise(html: Column, noise: str) -> Column:
    """Replace ignored elements and comments by an empty tag, which still separates text."""
    return F.regexp_replace(html, noise, "$1<x>")


def mark_tags(html: Column, markup: str) -> Column:
    """`html` with a pair of marks for every tag or ignored element, around those that matter."""
    return F.regexp_replace(F.translate(html, OPEN + CLOSE, ""), markup, f"{OPEN}$1{CLOSE}")


def _segments(marked: Column, element: str) -> Column:
    """What follows each marked start tag of an element, up to the next one; the tag comes first."""
    return F.slice(F.split(marked, rf"{OPEN}(?=(?i:<{element})[\t\n\r\f />])"), 2, 1_000_000_000)


def _address(segment: Column) -> Column:
    """Undecoded address of the start tag that a segment begins with."""
    value = F.regexp_extract(F.substring_index(segment, CLOSE, 1), _ADDRESS, 1)
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def base_address(marked: Column) -> Column:
    """Undecoded address of the first `base` tag that has one, or null."""
    return F.when(F.lower(marked).contains("<base"), _address(F.get(
        _segments(marked, "base"), 0)))


def link_addresses(marked: Column) -> Column:
    """Undecoded addresses of all `a` tags, whether they close or not."""
    return F.transform(_segments(marked, "a"), _address)


def anchors(marked: Column, limit: int | None) -> Column:
    """Array of (value, inner) for `<a href>` elements that close, in document order.

    A second start tag with an address before the end takes the place of the first.
    """
    end = f"{OPEN}</"
    found = F.transform(
        F.filter(_segments(marked, "a"), lambda s: s.contains(end)),
        lambda s: F.struct(_address(s).alias("value"), F.substr(
            F.substring_index(s, end, 1), F.length(F.substring_index(s, CLOSE, 1)) + 2
        ).alias("inner")))
    return first_items(F.filter(found, lambda a: a["value"] != ""), limit)


def anchor_text(inner: Column) -> Column:
    """Text of an anchor: entities decoded, marks and what they hold removed, blanks collapsed."""
    plain = F.translate(decode_entities(inner), OPEN + CLOSE, "")
    held = F.regexp_replace(decode_entities(F.regexp_replace(
        inner, f"{OPEN}[^{CLOSE}]++{CLOSE}", OPEN)), OPEN, "")
    return collapse_space(F.when(inner.contains(f"{OPEN}<"), F.translate(held, CLOSE, "")).otherwise(
        plain))


@lru_cache(maxsize=None)
def visible_text_stages() -> tuple[Stage, ...]:
    """Stages from `html` to `clean_html` and `visible_text`."""

    def clean(c: Getter) -> dict[str, Column]:
        return {"clean_html": drop_noise(c("html"), TEXT_NOISE)}

    def pieces(c: Getter) -> dict[str, Column]:
        return {"pieces": F.split(c("clean_html"), TAG)}

    def text(c: Getter) -> dict[str, Column]:
        shown = F.filter(
            F.transform(c("pieces"), lambda p: decode_entities(p)), lambda p: p.rlike(f"[^{SPACE}]"))
        return {"visible_text": F.array_join(shown, " ")}

    return (clean, pieces, text)
