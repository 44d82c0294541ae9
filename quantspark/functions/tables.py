"""Table functions for SQL: ``SELECT ... FROM documents, LATERAL find_numbers(text)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quantspark.functions import formats, numbers, text
from quantspark.session import ship


@udtf(returnType="sent_idx int, start int, end int, sentence string")
class SplitSentences:
    """The sentences of a text, paragraph breaks among them; none of a null."""

    def eval(self, body: str) -> Iterator[tuple]:
        for k, (a, b) in enumerate(text.split_sentences(body) if body else ()):
            yield k, a, b, body[a:b]


@udtf(returnType="start int, end int, number string, value double")
class FindNumbers:
    """The numbers of a text, with their values where they have one; none of a null."""

    def eval(self, body: str) -> Iterator[tuple]:
        for a, b in numbers.find_numbers(body) if body else ():
            value = numbers.parse(body[a:b])
            yield a, b, body[a:b], None if value is None else float(value)


@udtf(returnType="spelling string")
class NumberSpellings:
    """All spellings of a whole number in words; none of a null or of a number with decimals."""

    def eval(self, number: float) -> Iterator[tuple]:
        if number is not None and number == int(number):
            for s in formats.spellings(int(number)):
                yield (s,)


@udtf(returnType="notation string")
class DigitNotations:
    """All notations in digits that stay near a number; none of a null."""

    def eval(self, number: float) -> Iterator[tuple]:
        for s in formats.notations(float(number)) if number is not None else ():
            yield (s,)


NAMES = {"split_sentences": SplitSentences, "find_numbers": FindNumbers, "number_spellings": NumberSpellings, "digit_notations": DigitNotations}


def register(spark: SparkSession) -> None:
    """Make all table functions known to the session's SQL."""
    ship(spark)
    for name, function in NAMES.items():
        spark.udtf.register(name, function)
