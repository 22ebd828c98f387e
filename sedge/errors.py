"""Coded errors: every specification that isn't supported raises one before anything runs."""

from __future__ import annotations

import re
from contextlib import contextmanager

BAD_VALUE, FAILED_TO_PARSE, NO_NAMESPACE, NO_CURSOR, NO_COMMAND = 2, 9, 26, 43, 59
WRITE_CONFLICT = 112
NO_DROP, INVALID_OPTIONS, OPTIONS_CONFLICT, INVALID_DOCUMENT, DUPLICATE_KEY = 67, 72, 85, 121, 11000


#: Spark's conditions that a document's values can bring about.
_DATA = re.compile(r"\[(ARITHMETIC_OVERFLOW|BINARY_ARITHMETIC_OVERFLOW|DIVIDE_BY_ZERO|CAST_INVALID_INPUT|CAST_OVERFLOW|NUMERIC_VALUE_OUT_OF_RANGE|USER_RAISED_EXCEPTION)[^\]]*\] ?([^\n]*)")


class QueryError(Exception):
    """``code`` is the error's number, ``message`` says what is wrong with which part."""

    def __init__(self, code: int, message: str):
        super().__init__(f"{message} (code {code})")
        self.code, self.message = code, message


@contextmanager
def coded():
    """Errors that come up as documents are read (overflow, division by zero, a value of the wrong kind) as coded ones."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        if (found := _DATA.search(str(e))) is None:
            raise
        raise QueryError(BAD_VALUE, f"{found[1].lower().replace('_', ' ')}: {found[2]}") from e
