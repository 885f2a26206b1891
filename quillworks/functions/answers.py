"""Reading the answer of a text model: one JSON object with three text fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillworks.functions.scalars import strip

# The fields of an answer and the patterns around it.
FIELDS = ["repurposed_content", "caption", "hashtags"]
OPENING_FENCE = r"^```(?:json)?\s*"
CLOSING_FENCE = r"\s*```$"
OUTERMOST_BRACES = r"(?s)\{.*\}"


# The JSON parser stops after the first value. In an array whose last element is this
# mark, anything but one complete value in front of it shows.
END_MARK = "end of answer"


def without_fences(answer: Column) -> Column:
    """Answer without the code fence that may surround it."""
    opened = F.regexp_replace(strip(answer), OPENING_FENCE, "")
    return strip(F.regexp_replace(opened, CLOSING_FENCE, ""))


def json_part(bare: Column) -> Column:
    """The outermost braces of a text, or the whole text when it has none."""
    return F.coalesce(F.regexp_substr(bare, F.lit(OUTERMOST_BRACES)), bare)


# Everything up to the next NaN or Infinity outside a text, whole texts included.
UP_TO_NO_NUMBER = r'\G((?:[^"NI-]++|"(?:[^"\\]++|\\.)*+"|-(?!Infinity)|N(?!aN)|I(?!nfinity))*+)(?:NaN|-?Infinity)'


def plain_numbers(text: Column) -> Column:
    """NaN and infinities, which the application's reader accepts, as an ordinary number: no text either."""
    doubtful = F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity"))
    return F.when(doubtful, F.regexp_replace(text, UP_TO_NO_NUMBER, "$10")).otherwise(text)


def marked_array(text: Column) -> Column:
    """Variant of the text and the end mark in one array, NULL for malformed JSON."""
    return F.try_parse_json(F.concat(F.lit("["), plain_numbers(text), F.lit(f', "{END_MARK}"]')))


def only_value(marked: Column) -> Column:
    """The value in front of the end mark if it is the only one, else NULL."""
    complete = (F.try_variant_get(marked, "$[1]", "string") == END_MARK) & F.try_variant_get(
        marked, "$[2]", "variant"
    ).isNull()
    return F.when(complete, F.try_variant_get(marked, "$[0]", "variant"))


def answer_error(value: Column) -> Column:
    """Why a parsed answer cannot be used; NULL when it can.

    A missing field is allowed; a field that is not text (JSON null included) is not.
    """
    wrong_type = F.concat_ws(
        ", ",
        *[
            F.when(
                F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant")) != "STRING",
                F.lit(field),
            )
            for field in FIELDS
        ],
    )
    return (
        F.when(value.isNull(), "answer is not valid JSON")
        .when(~F.schema_of_variant(value).startswith("OBJECT"), "answer is not a JSON object")
        .when(wrong_type != "", F.concat(F.lit("not a text: "), wrong_type))
    )


def answer_field(value: Column, field: str) -> Column:
    """Stripped text of one field, empty when the field is missing."""
    return F.coalesce(strip(F.try_variant_get(value, f"$.{field}", "string")), F.lit(""))


def answer_texts(value: Column, error: Column) -> Column:
    """The three texts, a success flag and the error as one struct; failed answers have empty texts."""
    return F.struct(
        *[F.when(error.isNull(), answer_field(value, f)).otherwise("").alias(f) for f in FIELDS],
        error.isNull().alias("success"),
        error.alias("error"),
    )


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def parse_answer(answer: Column) -> Column:
    """Struct of the texts of an answer, see :func:`answer_texts`."""
    return named(
        without_fences(answer),
        lambda bare: named(
            marked_array(json_part(bare)),
            lambda marked: named(
                only_value(marked),
                lambda value: named(answer_error(value), lambda error: answer_texts(value, error)),
            ),
        ),
    )
