"""Endpoints among the arguments of calls, by syntax: a lexer that knows regular expressions, nested templates and comments
from what stands before them, and a stack of open brackets that tells calls from groups, definitions and constructors.

The stack keeps for each bracket whether an operand has just ended, which decides what the next mark means: a slash divides
or begins a regular expression, a parenthesis calls or groups, a brace is an object or a block. A text in which brackets do
not match, a literal does not end, or two operands meet on a line is no program and has no calls. One pass over the text,
whose memory is the open brackets and what was found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from scansmith.operators.validate import endpoint

# What makes a string an endpoint, and what a caller's name holds.
_ENDPOINT = re.compile(r"^(https?://|/(api|v\d+|rest|graphql|auth|admin|internal))")
_CALLERS = "fetch axios get post put delete patch request ajax open navigate".split()

_BREAK = re.compile("\r\n|[\n\r\u2028\u2029]")
_TOKEN = re.compile(
    r"""(?P<skip>//[^\n\r\u2028\u2029]*|/\*.*?\*/|\s+|async(?=[ \t]+function\b))
    |(?P<string>"(?:\\\r\n|\\.|[^"\\\n\r])*"|'(?:\\\r\n|\\.|[^'\\\n\r])*')
    |(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
    |(?P<name>(?:[^\W\d]|[$\#])[\w$\u200c\u200d]*)
    |(?P<mark>=>|\?\.(?!\d)|\.\.\.|\+\+|--|[{}()\[\];,.?:~`/]|[<>=!+\-*%&|^]+)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\]|[^/\\\[\n\r])+/[\w$]*")
_QUASI = re.compile(r"((?:\\.|\$(?!\{)|[^`\\$])*)(`|\$\{)", re.S)
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]{1,6})\}|(\r\n|.))", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", **dict.fromkeys(("\n", "\r", "\r\n", "\u2028", "\u2029"), "")}

_HEADS = set("if while for with switch catch".split())  # before a parenthesis that is no call
_BEFORE_STATEMENT = set("else do try finally".split())
_PREFIXES = set("return typeof delete void throw case default yield await var let const import break continue".split())
_INFIXES = set("in instanceof extends".split())
_CONTEXTUAL = set("as from of async get set static".split())  # names that may stand beside an operand
_NAMELESS = set("this super null true false".split())
_STATEMENTS, _KEYED = ("block", "class"), ("object", "class")


class NoProgram(ValueError):
    """The text is not a program."""


@dataclass
class _Open:
    """An open bracket, and where its content stands."""

    kind: str  # block, object, class, group, call, new, head, params, index, array or template
    close: str
    leaves: str = "operand"  # what stands behind it: an operand, the start of a statement or key, or a key
    name: str = ""  # a call's callee
    operand: bool = False  # an operand has just ended
    start: bool = False  # at the start of a statement, or at a key
    soft: bool = False  # that operand may stand beside another one
    mixed: bool = False  # an operator came
    size: int = 0  # what came since the last comma
    said: tuple | None = None  # the literal that is all that came: (kind, [(string, place)])
    chain: str = ""  # what a call of the operand that has just ended would be known by
    plain: bool = False  # that is a mere identifier
    news: int = 0  # constructors whose arguments may come
    ternaries: int = 0
    pending: str = ""  # what the next bracket is: head, params, body, class or arrow
    body: str = "operand"  # what that leaves
    quasis: list = field(default_factory=list)  # of a template: its strings and their places
    tagged: bool = False


def _cooked(token: str) -> str:
    """The value of a string literal."""

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        return chr(min(int(code, 16), 0x10FFFF)) if code else _ESCAPED.get(m[4], m[4])

    return _ESCAPE.sub(one, token[1:-1]) if "\\" in token else token[1:-1]


class Program:
    """calls: (callee's name, literal's kind, [(string, place)]) of each direct argument; strings: (string, place) of all literals."""

    def __init__(self, text: str) -> None:
        self.text, self.calls, self.strings = text, [], []
        self.top = _Open("block", "", start=True)
        self.stack = [self.top]
        at, newline, dotted, last = 0, False, False, ""
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise NoProgram(f"at {at}")
            kind, token = m.lastgroup, m[0]
            if kind == "skip":
                newline, at = newline or bool(_BREAK.search(token)), m.end()
                continue
            if token == "/" and not self.top.operand:
                m, kind = _REGEX.match(text, at), "regex"
                if m is None:
                    raise NoProgram(f"regular expression at {at}")
            if self.top.pending == "arrow" and token != "{":
                self.top.pending = ""
            begun, at = at, m.end()
            if kind == "mark":
                at = self._mark(token, begun, at, newline, last)
            elif kind == "name":
                self._member(token) if dotted else self._name(token, newline, text.startswith("(", at))
            else:
                said = (kind, [(_cooked(token), begun)]) if kind == "string" else None
                self.strings += said[1] if said else []
                self._operand(newline, said)
            dotted, last, newline = token in (".", "?.") and kind == "mark", token, False
        if len(self.stack) > 1:
            raise NoProgram("a bracket is open")

    def _restart(self) -> None:
        """A new statement, key or argument."""
        top = self.top
        top.operand, top.soft, top.size, top.said, top.chain, top.plain, top.news, top.ternaries, top.pending = False, False, 0, None, "", False, 0, 0, ""
        top.start = top.kind in ("block", *_KEYED)

    def _begin(self, newline: bool) -> None:
        """Something that can't follow an operand, unless a line ends between."""
        if self.top.operand and not self.top.soft and self.top.pending != "class":
            if not newline or self.top.kind not in _STATEMENTS:
                raise NoProgram("two operands")
            self._restart()

    def _operand(self, newline: bool, said: tuple | None = None, chain: str = "", plain: bool = False, soft: bool = False) -> None:
        self._begin(newline)
        top = self.top
        top.said, top.size = None if top.size else said, top.size + 1
        top.operand, top.start, top.soft, top.chain, top.plain = True, top.start and top.kind in _KEYED, soft, chain, plain

    def _operator(self) -> None:
        top = self.top
        top.operand, top.start, top.soft, top.mixed, top.size, top.said, top.chain, top.plain, top.news = False, False, False, True, top.size + 1, None, "", False, 0

    def _member(self, name: str) -> None:
        top = self.top
        top.chain, top.plain, top.operand, top.soft, top.said, top.size = f"{top.chain}.{name}" if top.plain else name, False, True, False, None, top.size + 1

    def _name(self, name: str, newline: bool, called: bool) -> None:
        top = self.top
        if top.kind == "class" and top.operand and newline and not top.start and not top.pending:
            self._restart()
        if top.pending == "params" or (top.pending == "head" and name == "await"):
            return  # a function's name; a loop that awaits
        if top.start and top.kind in _KEYED:
            top.operand, top.soft = True, True
        elif name in _INFIXES or (top.operand and name in ("of", "as", "from")):
            self._operator()
        elif name in _HEADS or name in _BEFORE_STATEMENT:
            self._begin(newline)
            self._restart()
            top.start, top.pending = top.kind == "block", "head" if name in _HEADS else ""
        elif name in ("function", "class"):
            self._begin(newline)
            top.pending, top.body = "params" if name == "function" else "class", "start" if top.start else "operand"
        elif name == "new":
            news = top.news
            self._begin(newline)
            self._operator()
            top.news = news + 1
        elif name in _PREFIXES and not (name == "import" and called):
            self._begin(newline)
            self._operator()
        elif name == "export":
            self._begin(newline)
        else:
            nameless = name in _NAMELESS or name == "import"
            self._operand(newline, None, "" if nameless else name, not nameless, name in _CONTEXTUAL)

    def _push(self, kind: str, close: str, leaves: str = "operand", **more: object) -> None:
        self.top = _Open(kind, close, leaves, start=kind in ("block", *_KEYED), **more)
        self.stack.append(self.top)

    def _mark(self, token: str, begun: int, at: int, newline: bool, last: str) -> int:
        top = self.top
        key = top.start and top.kind in _KEYED
        if token == "(":
            if top.pending in ("head", "params"):
                self._push(top.pending, ")")
            elif key and top.operand:  # a method
                top.body = "start" if top.kind == "class" else "operand"
                self._push("params", ")")
            elif top.operand:
                self._push("new" if top.news else "call", ")", name=top.chain)
                top.news = max(0, top.news - 1)
            else:
                self._push("group", ")")
        elif token == "[":
            self._push("index" if top.operand and not key else "array", "]", "key" if key else "operand")
        elif token == "{":
            if top.pending in ("body", "arrow", "head"):
                self._push("block", "}", {"body": top.body, "arrow": "operand", "head": "start"}[top.pending])
            elif top.pending == "class":
                self._push("class", "}", top.body)
            elif key and last == "static":
                self._push("block", "}", "start")
            elif key:
                raise NoProgram("a brace for a key")
            else:
                self._begin(newline)
                self._push("block" if top.start else "object", "}", "start" if top.start else "operand")
            top.pending = ""
        elif token in (")", "]", "}"):
            if token != top.close:
                raise NoProgram(f"{token} at {begun}")
            return self._quasi(at, newline) if top.kind == "template" else self._close(at)
        elif token == "`":
            tagged = top.operand and not top.soft and not newline
            if not tagged:
                self._begin(newline)
            self._push("template", "}", tagged=tagged)
            return self._quasi(at, newline)
        elif token == ";":
            if top.kind not in ("block", "class", "head"):
                raise NoProgram(f"; at {begun}")
            self._restart()
        elif token == "," and top.kind in ("call", "object"):
            self._argument()
            self._restart()
        elif token == ":" and not top.ternaries and top.kind == "block":
            self._restart()
        elif token in ("++", "--") and top.operand and not newline:
            top.size, top.said, top.chain, top.mixed = top.size + 1, None, "", True
        elif token in (".", "?.") or (token == "*" and (key or top.pending == "params")):
            pass
        else:
            top.ternaries += (token == "?") - (token == ":" and top.ternaries > 0)
            self._operator()
            top.pending = "arrow" if token == "=>" else top.pending
        return at

    def _argument(self) -> None:
        if self.top.kind == "call" and self.top.size == 1 and self.top.said:
            self.calls.append((self.top.name, *self.top.said))

    def _close(self, at: int) -> int:
        self._argument()
        own = self.stack.pop()
        top = self.top = self.stack[-1]
        if own.kind == "head":
            self._restart()
            top.start = top.kind == "block"
        elif own.kind == "params":
            top.pending, top.operand, top.soft, top.start = "body", False, False, False
        elif own.kind in ("call", "new"):
            top.operand, top.soft, top.chain, top.plain, top.said, top.size = True, False, "", False, None, top.size + 1
        elif own.kind == "index":  # a computed member is known by its literal or name
            literal = own.said if own.size == 1 else None
            self._member(literal[1][0][0] if literal and literal[0] == "string" else own.chain if own.plain and own.size == 1 else "")
        elif own.kind == "group" and not own.mixed:
            self._operand(False, own.said, own.chain, own.plain)
        elif own.leaves == "key":
            top.operand, top.soft = True, True
        elif own.leaves == "start":
            self._restart()
        else:
            top.operand = False
            self._operand(False)
        return at

    def _quasi(self, at: int, newline: bool) -> int:
        """A template's next string, and its end if it is the last one."""
        m = _QUASI.match(self.text, at)
        if m is None:
            raise NoProgram(f"template at {at}")
        own = self.top
        own.quasis.append((m[1], at))
        if m[2] == "`":
            self.stack.pop()
            top = self.top = self.stack[-1]
            if own.tagged:
                top.chain, top.plain, top.said, top.size = "", False, None, top.size + 1
            else:
                self._operand(newline, ("template", own.quasis))
        else:
            self._restart()
        return m.end()


def _placed(text: str, found: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """(string, line) in order of place."""
    line, at, out = 1, 0, []
    for value, place in sorted(found, key=lambda x: x[1]):
        line, at = line + len(_BREAK.findall(text, at, place)), place
        out.append((value, line))
    return out


def all_strings(text: str) -> list[tuple[str, int]]:
    """(string, line) of every string literal of a program."""
    try:
        return _placed(text, Program(text).strings)
    except NoProgram:
        return []


def call_strings(text: str) -> list[tuple[str, int]]:
    """(string, line) of the endpoint-like strings that are direct arguments of calls; templates too, if the caller's name tells."""
    try:
        calls = Program(text).calls
    except NoProgram:
        return []
    found = [s for name, kind, said in calls if kind == "string" or any(c in name.lower() for c in _CALLERS) for s in said if _ENDPOINT.match(s[0])]
    first: dict[str, int] = {}
    for value, place in sorted(found, key=lambda x: x[1]):
        first.setdefault(value, place)
    return _placed(text, list(first.items()))


_MATCHES = ArrayType(StructType([StructField(n, t) for n, t in (("match_ord", IntegerType()), ("value", StringType()), ("line", IntegerType()), ("after", StringType()))]))


@F.pandas_udf(_MATCHES)
def _call_matches(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"match_ord": k, "value": v, "line": n, "after": None} for k, (v, n) in enumerate(call_strings(t))] if t else [])


def call_matches(text: Column) -> Column:
    """The strings of `call_strings` as the match kernel gives matches; texts without a call or a literal that may be an endpoint stay in the JVM."""
    return _call_matches(F.when(F.contains(text, F.lit("(")) & text.rlike("[\"'`}](?:https?://|/|\\\\)"), text))


def call_endpoints(docs: DataFrame) -> DataFrame:
    """(source, value, line) of endpoints that docs (source, text) pass to calls."""
    found = docs.select("source", F.explode(call_matches(F.col("text"))).alias("m"))
    return found.select("source", "m.value", "m.line").where(endpoint(F.col("value")))
