"""Functions for users of SQL: deobfuscate(text), shannon_entropy(text), and the table functions js_calls(text) and js_strings(text)."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scansmith.functions import text as T
from scansmith.operators.calls import all_strings, call_strings

_HEX, _UNICODE = re.compile(r"\\x([0-9a-fA-F]{2})"), re.compile(r"\\u([0-9a-fA-F]{4})")
_ATOB, _BTOA, _SUM, _CODES = (re.compile(x) for x in (T._ATOB, T._BTOA, T._SUM, T._CODES))


def _decoded(m: re.Match) -> str:
    try:
        return f'"{base64.b64decode(m[1]).decode("utf-8", "replace")}"'
    except (binascii.Error, ValueError):
        return m[0]


def _from_codes(m: re.Match) -> str:
    try:
        return '"' + "".join(chr(int(c)) for c in m[1].split(",")) + '"'
    except (ValueError, OverflowError):
        return m[0]


def plain(text: str) -> str:
    """What `text.plain` says, for one string; scans use that one, which never leaves the JVM."""
    text = _UNICODE.sub(lambda m: chr(int(m[1], 16)), _HEX.sub(lambda m: chr(int(m[1], 16)), text))
    text = _BTOA.sub(lambda m: f'"{base64.b64encode(m[1].encode("utf-8", "surrogatepass")).decode()}"', _ATOB.sub(_decoded, text))
    before = None
    while before != text:
        before, text = text, _SUM.sub(lambda m: f'"{m[2]}{m[4]}"', text)
    return _CODES.sub(_from_codes, text).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@F.pandas_udf(StringType())
def _plain(texts: pd.Series) -> pd.Series:
    return texts.map(plain, na_action="ignore")


class _Calls:
    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        yield from call_strings(text or "")


class _Strings:
    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        yield from all_strings(text or "")


def register(spark: SparkSession) -> None:
    """Make the functions known to a session."""
    spark.udf.register("deobfuscate", _plain)
    spark.udtf.register("js_calls", F.udtf(_Calls, returnType="value string, line int"))
    spark.udtf.register("js_strings", F.udtf(_Strings, returnType="value string, line int"))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION shannon_entropy(v STRING) RETURNS DOUBLE RETURN "
        "aggregate(array_distinct(filter(split(v, ''), c -> c <> '')), 0D, (a, c) -> a - (length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v)))"
    )
