"""Text functions: Python-compatible regular expressions, strip, entropy, masks, and undoing simple obfuscation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scansmith.catalog import Pattern

_STRIP = "(?U)^\\s+|\\s+$"


def java(regex: str, fold: bool = False, dotall: bool = False) -> str:
    """regex with the flags under which Java matches as Python does: only a line feed ends a line, classes are Unicode's."""
    return f"(?d{'iu' * fold}{'s' * dotall}U){regex}"


def java_of(p: Pattern) -> str:
    return java(p.regex, p.fold, p.dotall)


def closing_of(p: Pattern) -> str | None:
    """An expression of a text up to the last place where a match can end."""
    return java(f"(?s:^.*)(?:{p.closing})", p.fold, p.dotall) if p.closing else None


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def masked(v: Column) -> Column:
    """The first 10 and last 4 characters of what is longer than 20."""
    return F.when(F.length(v) > 20, F.concat(F.substring(v, 1, 10), F.lit("..."), F.right(v, F.lit(4)))).otherwise(v)


def shortened(v: Column, most: int = 80) -> Column:
    return F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("..."))).otherwise(v)


def redacted(v: Column, fully: bool = False) -> Column:
    """The first and last 4 characters, 2 of what has at most 12, none of what has at most 4."""
    ends = lambda n: F.concat(F.substring(v, 1, n), F.lit("..."), F.right(v, F.lit(n)))
    return F.lit("****REDACTED****") if fully else F.when(F.length(v) <= 4, "****").when(F.length(v) <= 12, ends(2)).otherwise(ends(4))


#: What may not stand in a script's string as it is, and what stands for it; in this order.
SCRIPT_ESCAPES = {"\\": "\\\\", "'": "\\'", '"': '\\"', "\n": "\\n", "\r": "\\r", "<": "\\x3c", ">": "\\x3e"}


def script_string(v: Column) -> Column:
    """v as it may stand between quotes in a script within a page."""
    for bare, escaped in SCRIPT_ESCAPES.items():
        v = F.replace(v, F.lit(bare), F.lit(escaped))
    return v


def shannon_entropy(v: Column) -> Column:
    """Bits a character, over code points; 0 for the empty string."""
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits + F.lit(0.0)).otherwise(F.lit(0.0))


# The shapes of what obfuscation leaves, which fix what is undone.
_HEX, _UNICODE = "\\\\x([0-9a-fA-F]{2})", "\\\\u([0-9a-fA-F]{4})"
_ATOB, _BTOA = "atob\\s*\\(\\s*[\"']([A-Za-z0-9+/=]+)[\"']\\s*\\)", "btoa\\s*\\(\\s*[\"']([^\"']+)[\"']\\s*\\)"
_SUM = "([\"'])([^\"']*)\\1\\s*\\+\\s*([\"'])([^\"']*)\\3"
_CODES = "String\\.fromCharCode\\s*\\(\\s*([0-9,\\s]+)\\s*\\)"
_HALVINGS = 30  # of sums: a sum of 2**30 strings is one string after so many passes


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once, however often use names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _replaced(text: Column, regex: str, by: Callable[[Column], Column]) -> Column:
    """text with by(match) in place of each match of regex; where that is null, the match stays."""
    regex = java(regex)
    return F.array_join(F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda t, m: F.concat(t, F.coalesce(by(m), m, F.lit("")))), "")


# Fixed value: what looks like a secret in free text.
SECRET_LIKE = r"(?:ghp_|gho_|sk_live_|pk_live_|sk_test_|AKIA|xox[baprs]-|eyJ|sk-|Bearer\s+)[a-zA-Z0-9_\-./+=]{8,}"


def redacted_text(text: Column) -> Column:
    """Free text with all that looks like a secret shortened."""
    return _replaced(text, SECRET_LIKE, redacted)


def _of_utf16(units: Column) -> Column:
    """The text of hexadecimal UTF-16 units, each followed by a blank; half a pair becomes U+FFFD."""
    whole = F.regexp_replace(units, "(?i)\\b(?:d[89ab][0-9a-f]{2} (?!d[c-f])|(?<!\\bd[89ab][0-9a-f]{2} )d[c-f][0-9a-f]{2} )", "fffd ")
    return F.decode(F.unhex(F.replace(whole, F.lit(" "), F.lit(""))), "UTF-16BE")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _of_base64(m: Column) -> Column:
    """The text in a call that decodes base64, null if it is none: data end at the first padding, which must fill its block of four."""
    said = F.regexp_extract(m, java(_ATOB), 1)
    data = F.regexp_extract(said, "^[^=]*", 0)
    rest, pads = F.length(data) % 4, F.length(said) - F.length(F.replace(said, F.lit("="), F.lit("")))
    good = (rest == 0) | ((rest == 2) & (pads >= 2)) | ((rest == 3) & (pads >= 1))
    read = F.try_to_binary(F.rpad(data, (F.ceil(F.length(data) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    return F.when(good & F.startswith(said, data), _quoted(F.make_valid_utf8(read.cast("string"))))


def _of_codes(m: Column) -> Column:
    """The text of character codes, null if one is no number or no character."""
    codes = F.transform(F.split(F.regexp_extract(m, java(_CODES), 1), ","), lambda c: strip(c).try_cast("decimal(38,0)"))
    good = F.forall(codes, lambda c: c.isNotNull() & (c <= 0x10FFFF))
    units = lambda c: F.when(c < 0x10000, F.format_string("%04x ", c)).otherwise(F.format_string("%04x %04x ", F.shiftright(c - 0x10000, 10) + 0xD800, (c - 0x10000) % 1024 + 0xDC00))
    return F.when(good, _quoted(_of_utf16(F.array_join(F.transform(codes, lambda c: units(c.cast("int"))), ""))))


def collapsed_sums(text: Column, passes: int = _HALVINGS) -> Column:
    """Sums of string literals as one literal: each pass halves their operands, until one changes nothing."""

    def once(state: Column) -> Column:
        after = lambda t: F.struct(t.alias("t"), (t != state["t"]).alias("more"))
        return F.when(state["more"], let(F.regexp_replace(state["t"], java(_SUM), '"$2$4"'), after)).otherwise(state)

    begin = F.struct(text.alias("t"), F.contains(text, F.lit("+")).alias("more"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), begin, lambda state, _: once(state), lambda state: state["t"])


def plain(text: Column) -> Column:
    """Escapes, base64 literals, string sums and character codes replaced by what they stand for, in this order; U+FFFD for half a surrogate pair."""
    runs = lambda regex: f"(?:{regex})+"
    steps = [
        ("\\x", lambda t: _replaced(t, runs(_HEX), lambda m: F.decode(F.unhex(F.replace(m, F.lit("\\x"), F.lit(""))), "ISO-8859-1"))),
        ("\\u", lambda t: _replaced(t, runs(_UNICODE), lambda m: _of_utf16(F.regexp_replace(m, java(_UNICODE), "$1 ")))),
        ("atob", lambda t: _replaced(t, _ATOB, _of_base64)),
        ("btoa", lambda t: _replaced(t, _BTOA, lambda m: _quoted(F.base64(F.encode(F.regexp_extract(m, java(_BTOA), 1), "UTF-8"))))),
        ("+", lambda t: F.when(t.rlike("[\"'](?U:\\s*)\\+"), collapsed_sums(t)).otherwise(t)),
        ("fromCharCode", lambda t: _replaced(t, _CODES, _of_codes)),
    ]
    gated = lambda sign, step: lambda t: F.when(F.contains(t, F.lit(sign)), step(t)).otherwise(t)
    for sign, step in steps:
        text = let(text, gated(sign, step))
    return text


def deobfuscated(text: Column) -> Column:
    """text without simple obfuscation, by expressions alone; those of a step run only on texts with a sign of it."""
    signs = F.lit(False)
    for sign in ("\\x", "\\u", "atob", "btoa", "fromCharCode"):
        signs = signs | F.contains(text, F.lit(sign))
    return F.when(signs | text.rlike("[\"'](?U:\\s*)\\+"), plain(text)).otherwise(text)
