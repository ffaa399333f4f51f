"""Text templates of the retrieval step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of the prompt and of the citation card.
CONTEXT_HEADING = "Konteks yang Tersedia:\n"
QUESTION_HEADING = "\n\nPertanyaan Pengguna:\n"
SOURCE_LABEL = " [Sumber: "
NUMBER_LABEL = " Nomor: "
QUESTION_BADGE = ":blue-badge[Tanya:] "
ANSWER_BADGE = ":green-badge[Jawab:] "


def shown(value: Column) -> Column:
    """A null is shown as the word ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def context_line(question: Column, answer: Column, kind: Column, number: Column) -> Column:
    """``- question answer [Sumber: kind Nomor: number] `` with its trailing space."""
    return F.concat(
        F.lit("- "),
        shown(question),
        F.lit(" "),
        shown(answer),
        F.lit(SOURCE_LABEL),
        shown(kind),
        F.lit(NUMBER_LABEL),
        shown(number),
        F.lit("] "),
    )


def prompt_text(context: Column, question: Column) -> Column:
    return F.concat(
        F.lit(CONTEXT_HEADING), context, F.lit(QUESTION_HEADING), shown(question)
    )


def card_heading(kind: Column, number: Column, permalink: Column, topics: Column) -> Column:
    return F.concat(
        F.lit("**"),
        shown(kind),
        F.lit(NUMBER_LABEL),
        shown(number),
        F.lit("**\n\n**ID**: `"),
        shown(permalink),
        F.lit("`\n\n**Topik**: "),
        shown(topics),
    )


def card_body(question: Column, answer: Column) -> Column:
    return F.concat(
        F.lit(QUESTION_BADGE),
        shown(question),
        F.lit("\n\n" + ANSWER_BADGE),
        shown(answer),
    )
