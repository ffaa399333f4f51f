"""HTML to text without leaving the JVM.

The text content of a document is everything outside tags and comments, with
entities decoded. Script and style bodies count as text: they may hold
tag-like strings and their entities stay as written.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags may carry ">" inside quoted attribute values. Possessive loops keep the
# matcher from recursing on long tags.
_TAG = r"""<[a-z/!?](?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+(?:>|\z)"""
_COMMENT = r"<!--.*?(?:-->|\z)"
_MARKUP = (
    r"(?is)<script\b[^>]*>(.*?)(?:</script\s*>|\z)"
    r"|<style\b[^>]*>(.*?)(?:</style\s*>|\z)"
    rf"|{_COMMENT}|{_TAG}"
)
_RAW_TEXT = rf"(?is){_COMMENT}|<(script|style)\b[^>]*>(.*?)(?:</\1\s*>|\z)"
_RAW_TEXT_WITH_AMPERSAND = (
    r"(?is)<(?:script|style)\b[^>]*>(?:(?!</(?:script|style))[^&])*+&"
)
_ENTITY = r"^(#0*+[0-9]{1,7}|#[xX]0*+[0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"

# Entities that nearly all documents are limited to; "&amp;" is decoded last.
_FREQUENT = ("lt", "gt", "quot", "nbsp", "copy", "middot")
_OTHER_ENTITY = r"&(?!amp;)(?:#[0-9xX]|[a-zA-Z])[0-9a-zA-Z]*;"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _entity_map() -> Column:
    """Constant map from entity name to character, folded by the planner."""
    points = {**name2codepoint, "apos": ord("'")}
    listed = "\u0001".join(f"{name}\u0002{chr(p)}" for name, p in points.items())
    return F.str_to_map(F.lit(listed), F.lit("\u0001"), F.lit("\u0002"))


def _significant(name: Column, start: int) -> Column:
    """Digits of a numeric reference from ``start`` on, without leading zeros."""
    digits = F.ltrim(F.substr(name, F.lit(start)), F.lit("0"))
    return F.when(digits == "", "0").otherwise(digits)


def _character(name: Column) -> Column:
    """Character for an entity name or numeric reference, else null."""
    point = F.when(
        name.rlike("^#[xX]"), F.conv(_significant(name, 3), 16, 10).cast("long")
    ).when(name.startswith("#"), _significant(name, 2).cast("long"))
    valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    numeric = F.when(
        valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    )
    return F.when(name.startswith("#"), numeric).otherwise(
        F.try_element_at(_entity_map(), name)
    )


def _decode_any(text: Column) -> Column:
    """Decode entities in one pass over the pieces between ampersands."""
    parts = F.split(text, "&")
    named = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda part: F.struct(
            part.alias("part"), F.regexp_extract(part, _ENTITY, 1).alias("name")
        ),
    )
    resolved = F.transform(
        named,
        lambda p: F.struct(
            p["part"].alias("part"),
            F.length(p["name"]).alias("length"),
            _character(p["name"]).alias("char"),
        ),
    )
    decoded = F.transform(
        resolved,
        lambda p: F.when(
            p["char"].isNotNull(),
            F.concat(
                p["char"], F.substring(p["part"], p["length"] + 2, F.length(p["part"]))
            ),
        ).otherwise(F.concat(F.lit("&"), p["part"])),
    )
    return F.concat(F.element_at(parts, 1), F.array_join(decoded, ""))


def decode_entities(text: Column) -> Column:
    """Decode named (HTML 4) and numeric entities; unknown ones stay.

    Plain replacements do for most texts. None of their results can form a new
    entity as long as the ampersand itself comes last.
    """
    common = text
    for name in _FREQUENT:
        common = F.replace(common, F.lit(f"&{name};"), F.lit(chr(name2codepoint[name])))
    return _once(
        common,
        lambda rest: F.when(rest.rlike(_OTHER_ENTITY), _decode_any(rest)).otherwise(
            F.replace(rest, F.lit("&amp;"), F.lit("&"))
        ),
    )


# Stands for an ampersand of a script or style body while entities are decoded. A text
# that holds it already gets it back, as every "SHIELD" becomes "SHIELD0" before.
_SHIELD = "\ufdd0"


def _shielded(spaced: Column) -> Column:
    """Hide the ampersands of script and style bodies."""
    raw = F.regexp_extract_all(spaced, F.lit(_RAW_TEXT), F.lit(0))
    hidden = F.lit(_SHIELD + "1")
    pieces = F.zip_with(
        F.split(spaced, _RAW_TEXT),
        raw,
        lambda outside, body: F.concat(
            outside, F.coalesce(F.replace(body, F.lit("&"), hidden), F.lit(""))
        ),
    )
    return F.array_join(pieces, "")


def _stripped(spaced: Column) -> Column:
    return decode_entities(F.regexp_replace(spaced, _MARKUP, "$1$2"))


def _stripped_apart(spaced: Column) -> Column:
    """As ``_stripped``, but ampersands of script and style bodies are no entities."""
    marked = F.replace(spaced, F.lit(_SHIELD), F.lit(_SHIELD + "0"))
    text = _stripped(_shielded(marked))
    shown = F.replace(text, F.lit(_SHIELD + "1"), F.lit("&"))
    return F.replace(shown, F.lit(_SHIELD + "0"), F.lit(_SHIELD))


def html_to_text(html: Column) -> Column:
    """Text content of ``html`` after ``>`` becomes ``> `` (keeps words apart)."""
    return _once(
        F.replace(html, F.lit(">"), F.lit("> ")),
        # Rare: a script or style body holds "&".
        lambda spaced: F.when(
            spaced.rlike(_RAW_TEXT_WITH_AMPERSAND), _stripped_apart(spaced)
        ).otherwise(_stripped(spaced)),
    )
