"""Text cleaning, normalising and chunking as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_body(text: Column) -> Column:
    """Delete CR, LF and TAB (words glue together) and turn ``"`` into ``'``."""
    # Plain replacements work on bytes: faster than a pattern or ``translate``.
    for char, replacement in (("\r", ""), ("\n", ""), ("\t", ""), ('"', "'")):
        text = F.replace(text, F.lit(char), F.lit(replacement))
    return text


def normalize_whitespace(text: Column) -> Column:
    """Collapse runs of Unicode white space to one space and strip the ends.

    Once every run is a single plain space, ``trim`` is all the strip there is.
    """
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def chunks(text: Column, chunk_size: int, overlap: int = 0) -> Column:
    """Overlapping pieces as ``array<struct<chunk, chunk_num>>``.

    A match consumes one step and looks ahead over one chunk, so the whole text
    is cut in a single pass; ``substring`` per chunk would rescan a UTF-8 text
    from its start each time. Empty text has no chunk.
    """
    step = chunk_size - overlap
    if chunk_size < 1 or overlap < 0 or step < 1:
        raise ValueError("need chunk_size > overlap >= 0")
    pattern = rf"(?s)(?=(.{{1,{chunk_size}}})).{{1,{step}}}"
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(
        pieces,
        lambda piece, i: F.struct(
            piece.alias("chunk"),
            F.concat(F.lit(f"{chunk_size}-"), (i + 1).cast("string")).alias("chunk_num"),
        ),
    )
