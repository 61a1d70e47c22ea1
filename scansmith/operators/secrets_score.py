"""Secrets' entropy, confidence and format checks, and quoted strings of high entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansmith import catalog as C
from scansmith.catalog import Pattern
from scansmith.functions.text import shannon_entropy, strip
from scansmith.operators.validate import _holds_any

HIGH_ENTROPY = [Pattern(7, 0, "secrets", "High-entropy string", C.HIGH_ENTROPY, 1, False, False, ("\"", "'"), "nonempty", "masked")]
LEAST_ENTROPY = 4.5
LINE_BREAK = "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]"


def doubtful_lines(text: Column) -> Column:
    """Of each line of a text, whether it is a comment or has signs of an example; so that no match carries its line along."""
    return F.transform(F.split(text, LINE_BREAK), lambda line: strip(line).rlike("^(?://|/\\*|\\*)") | _holds_any(F.lower(line), C.LOW_CONFIDENCE))


def confidence(value: Column, doubtful: Column, label: Column) -> Column:
    """low in doubtful lines and of values with signs of an example, high for well-known formats, else medium."""
    low = F.coalesce(doubtful, F.lit(False)) | _holds_any(F.lower(value), C.LOW_CONFIDENCE)
    return F.when(low, "low").when(label.isin(C.HIGH_CONFIDENCE), "high").otherwise("medium")


def _base64_ok(part: Column) -> Column:
    """Whether a lenient url-safe decoder takes a part: its length is not one above a multiple of four."""
    return F.length(F.regexp_replace(part, "[^A-Za-z0-9_+/-]", "")) % 4 != 1


def valid_format(value: Column, label: Column) -> Column:
    """Whether a secret has its kind's format; null for kinds without a rule."""
    parts = F.split(value, "\\.")
    jwt = (F.size(parts) == 3) & _base64_ok(F.get(parts, F.lit(0))) & _base64_ok(F.get(parts, F.lit(1)))
    return (
        F.when(label == "AWS Access Key", value.rlike("^AKIA[A-Z0-9]{16}$"))
        .when(label == "GitHub PAT", F.startswith(value, F.lit("ghp_")) & (F.length(value) == 40))
        .when(label.isin("Stripe Live Secret", "Stripe Test Secret"), value.rlike("^[sp]k_(live|test)_[0-9a-zA-Z]{24,}$"))
        .when(label == "JWT Token", jwt)
    )


def valid_aws_secret(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9/+=]{40}$")


def high_entropy(value: Column, threshold: float = LEAST_ENTROPY) -> Column:
    return (F.length(value) >= 16) & (shannon_entropy(value) > threshold)


def scored(found: DataFrame) -> DataFrame:
    """found (raw, doubtful, type, ...) with confidence, entropy and validated of secrets; too even strings are dropped."""
    bits, order = shannon_entropy(F.col("raw")), F.col("pass_ord")
    core, strings = order == C.SECRET_PASS, order == 7
    # computed where shown, so other findings cost nothing
    out = found.withColumn("bits", F.when(core | strings, bits)).where(~strings | (F.col("bits") > LEAST_ENTROPY))
    rounded = F.bround("bits", 2)
    valid = valid_format(F.col("raw"), F.col("type"))
    wrong = core & F.coalesce(~valid, F.lit(False))
    sure = F.when(wrong, "low").when(core, confidence(F.col("raw"), F.col("doubtful"), F.col("type"))).when(order.isin(5, 6), "high").when(strings, "medium")
    shown = F.concat(F.lit("High-entropy candidate (entropy="), F.format_string("%.2f", rounded), F.lit("): "), F.substring("raw", 1, 10), F.lit("..."), F.right("raw", F.lit(4)))
    return out.withColumns({"confidence": sure, "entropy": rounded, "validated": F.when(wrong, F.lit(False)), "value": F.when(strings, shown).otherwise(F.col("value"))}).drop("bits")
