"""The record filter language, compiled to columns.

An expression becomes a value with up to three columns: a number, a string and a truth.  ``truth`` is
what the value counts as in && and ||, where both operators have one precedence and group from the
left.  Operators on the wrong kind of value are errors when the expression is compiled; a tag, whose
kind is known per record only, raises when it is evaluated.

    expression  eq (('&&' | '||') eq)*
    eq          cmp [('==' | '!=' | '=~' | '!~') eq]
    cmp         or [('>=' | '>' | '<=' | '<') cmp]
    or, xor, and, add, mul   as usual, each grouping from the left
    unary       ('+' | '-') simple | ('!' | '~') unary | simple
    simple      '(' expression ')' | string | number | symbol | function '(' expression ')'

Functions: length, min, max, avg, sqrt, log, pow (two arguments), exp, and default (two arguments).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.sequence import FLAG_NAMES, end_position, query_length, reference_length


class FilterError(ValueError):
    """An expression that cannot be compiled."""


@dataclass(frozen=True)
class Value:
    """A compiled value. A number has ``num``; a string has ``text`` (null if absent); a tag has both,
    one of them null. ``truth`` overrides the usual truth of a number or string. ``literal`` is the text
    of a string constant."""

    num: Column | None = None
    text: Column | None = None
    truth: Column | None = None
    literal: str | None = None

    @property
    def is_true(self) -> Column:
        if self.truth is not None:
            return self.truth
        if self.num is None:
            return self.text.isNotNull()
        number = F.coalesce(self.num != 0, F.lit(False))
        return number if self.text is None else number | self.text.isNotNull()


def number(c: Column) -> Value:
    """A numeric value."""
    return Value(num=c.cast("double"))


def string(c: Column) -> Value:
    """A string value."""
    return Value(text=c)


def tag(num: Column, text: Column) -> Value:
    """A tag's value: present counts as true, even if it is 0."""
    return Value(num=num.cast("double"), text=text, truth=num.isNotNull() | text.isNotNull())


_TOKEN = re.compile(
    r"\s*(?:(?P<num>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    r"|\"(?P<str>(?:\\.|[^\"\\])*)\""
    r"|(?P<tag>\[[A-Za-z][A-Za-z0-9]\])"
    r"|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)"
    r"|(?P<op>&&|\|\||==|!=|=~|!~|>=|<=|[-+*/%&|^<>!~(),]))",
    re.S,
)

Resolver = Callable[[str], "Value | None"]


class _Parser:
    def __init__(self, text: str, resolve: Resolver) -> None:
        self.text, self.resolve, self.at = text, resolve, 0

    def peek(self) -> re.Match | None:
        return _TOKEN.match(self.text, self.at)

    def op(self, *wanted: str) -> str | None:
        m = self.peek()
        if m and m["op"] in wanted:
            self.at = m.end()
            return m["op"]
        return None

    def expression(self) -> Value:
        left = self.eq()
        while o := self.op("&&", "||"):
            right = self.eq()
            both = left.is_true & right.is_true if o == "&&" else left.is_true | right.is_true
            left = number(both.cast("int"))
        return left

    def eq(self) -> Value:
        left = self.cmp()
        o = self.op("==", "!=", "=~", "!~")
        if not o:
            return left
        right = self.eq()
        return _matches(left, right, o == "!~") if "~" in o else _equal(left, right, o == "!=")

    def cmp(self) -> Value:
        left = self.chain(0)
        o = self.op(">=", "<=", ">", "<")
        return _ordered(left, self.cmp(), o) if o else left

    def chain(self, level: int) -> Value:
        if level == len(_LEVELS):
            return self.unary()
        left = self.chain(level + 1)
        while o := self.op(*_LEVELS[level]):
            left = _arithmetic(left, self.chain(level + 1), o)
        return left

    def unary(self) -> Value:
        o = self.op("+", "-", "!", "~")
        if o in ("+", "-"):
            v = self.simple()
            return number(_number(v, o) * (1 if o == "+" else -1))
        if o == "!":
            v = self.unary()
            if v.num is None:
                return number((~v.is_true).cast("int"))
            whole = _long(v.num) == 0
            return number((whole if v.text is None else F.coalesce(whole, ~v.is_true)).cast("int"))
        if o == "~":
            return number(F.bitwise_not(_long(_number(self.unary(), o))))
        return self.simple()

    def simple(self) -> Value:
        if self.op("("):
            v = self.expression()
            if not self.op(")"):
                raise FilterError(f"missing ) in {self.text!r}")
            return v
        m = self.peek()
        if not m:
            raise FilterError(f"cannot read {self.text[self.at :]!r}")
        self.at = m.end()
        if m["num"]:
            return number(F.lit(float(int(m["num"], 16)) if m["num"][:2] in ("0x", "0X") else float(m["num"])))
        if m["str"] is not None:
            said = re.sub(r'\\(["\\])', r"\1", m["str"])
            return Value(text=F.lit(said), literal=said)
        name = m["tag"] or m["name"]
        if not name:
            raise FilterError(f"unexpected {m['op']!r} in {self.text!r}")
        found = self.resolve(name)
        if found is not None:
            return found
        if self.text[self.at : self.at + 1] == "(" and name in _FUNCTIONS:
            self.at += 1
            args = [self.expression()]
            while self.op(","):
                args.append(self.expression())
            if not self.op(")"):
                raise FilterError(f"missing ) after {name}")
            return _FUNCTIONS[name](*args)
        raise FilterError(f"unknown name {name!r}")


_LEVELS = (("|",), ("^",), ("&",), ("+", "-"), ("*", "/", "%"))


def _long(c: Column) -> Column:
    """A double cut to a whole number, saturating."""
    return F.when(F.isnan(c), F.lit(0)).otherwise(F.greatest(F.least(c, F.lit(9.2e18)), F.lit(-9.2e18))).cast("long")


def _number(v: Value, o: str) -> Column:
    if v.num is None:
        raise FilterError(f"operator {o} needs numbers")
    return v.num if v.text is None else F.coalesce(v.num, F.when(v.text.isNotNull(), F.raise_error(F.lit(f"operator {o} needs numbers")).cast("double")), F.lit(0.0))


def _arithmetic(a: Value, b: Value, o: str) -> Value:
    x, y = _number(a, o), _number(b, o)
    if o == "+":
        return number(x + y)
    if o == "-":
        return number(x - y)
    if o == "*":
        return number(x * y)
    if o == "/":
        zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
        return number(F.when(y == 0, zero).otherwise(F.try_divide(x, y)))
    i, j = _long(x), _long(y)
    if o == "%":
        return number(F.when(j == 0, F.lit(float("nan"))).otherwise(F.try_mod(i, j).cast("double")))
    return number({"&": i.bitwiseAND, "|": i.bitwiseOR, "^": i.bitwiseXOR}[o](j))


def _ordered(a: Value, b: Value, o: str) -> Value:
    apply = {">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y}[o]
    parts = [apply(x, y) for x, y in ((a.num, b.num), (a.text, b.text)) if x is not None and y is not None]
    return number(F.coalesce(*parts, F.lit(False)).cast("int"))


def _equal(a: Value, b: Value, differ: bool) -> Value:
    parts = [x == y for x, y in ((a.num, b.num), (a.text, b.text)) if x is not None and y is not None]
    same = F.coalesce(*parts, F.lit(False))
    return number((~same if differ else same).cast("int"))


# Bracket classes of POSIX regular expressions and their Java names.
_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "xdigit": "XDigit"}


def java_regex(pattern: str) -> str:
    """A POSIX extended regular expression in Java's syntax."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            out.append("\\" + nxt if nxt and not nxt.isalnum() else nxt)
            i += 2
            continue
        if c != "[":
            out.append(c)
            i += 1
            continue
        j = i + 1
        body = "[^" if pattern[j : j + 1] == "^" else "["
        j += len(body) - 1
        first = True
        while j < n and (pattern[j] != "]" or first):
            first = False
            if pattern.startswith("[:", j):
                close = pattern.find(":]", j)
                name = pattern[j + 2 : close]
                if close < 0 or name not in _POSIX:
                    raise FilterError(f"unknown bracket class in {pattern!r}")
                body += rf"\p{{{_POSIX[name]}}}"
                j = close + 2
            else:
                body += "\\" + pattern[j] if pattern[j] in "[]\\&^" else pattern[j]
                j += 1
        if j >= n:
            raise FilterError(f"unclosed bracket in {pattern!r}")
        out.append(body + "]")
        i = j + 1
    return "".join(out)


def _matches(a: Value, b: Value, differ: bool) -> Value:
    if a.text is None or b.text is None:
        raise FilterError("a regular expression needs strings")
    found = F.coalesce(F.regexp_like(a.text, b.text if b.literal is None else F.lit(java_regex(b.literal))), F.lit(False))
    return number((~found if differ else found).cast("int"))


def _text(v: Value, name: str) -> Column:
    if v.text is None:
        raise FilterError(f"{name} needs a string")
    return v.text


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def _average(text: Column) -> Column:
    codes = _codes(text)
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(codes) > 0, total / F.size(codes)).otherwise(F.lit(0.0))


_FUNCTIONS: dict[str, Callable[..., Value]] = {
    "length": lambda v: number(F.length(_text(v, "length"))),
    "min": lambda v: number(F.coalesce(F.array_min(_codes(_text(v, "min"))).cast("double"), F.lit(float("nan")))),
    "max": lambda v: number(F.coalesce(F.array_max(_codes(_text(v, "max"))).cast("double"), F.lit(float("nan")))),
    "avg": lambda v: number(_average(_text(v, "avg"))),
    "sqrt": lambda v: number(F.sqrt(_number(v, "sqrt"))),
    "exp": lambda v: number(F.exp(_number(v, "exp"))),
    "log": lambda v: number(F.log(_number(v, "log"))),
    "pow": lambda a, b: number(F.pow(_number(a, "pow"), _number(b, "pow"))),
    "default": lambda a, b: Value(num=None if b.num is None else F.coalesce(a.num, b.num) if a.num is not None else b.num, text=None if b.text is None else F.coalesce(a.text, b.text) if a.text is not None else b.text),
}


def compile_value(expression: str, resolve: Resolver) -> Value:
    """The value of a whole expression."""
    p = _Parser(expression, resolve)
    v = p.expression()
    if p.text[p.at :].strip():
        raise FilterError(f"left over: {p.text[p.at :]!r}")
    return v


def compile_filter(expression: str, resolve: Resolver) -> Column:
    """The truth of an expression."""
    return compile_value(expression, resolve).is_true


def columns_of(df: DataFrame) -> Resolver:
    """Names resolve to a table's columns: strings as strings, the rest as numbers. ``[XX]`` looks into a
    map column ``tags`` of struct<type,value>."""
    kinds = dict(df.dtypes)

    def resolve(name: str) -> Value | None:
        if name.startswith("["):
            if "tags" not in kinds:
                return None
            entry = F.element_at("tags", F.lit(name[1:3]))
            numeric = entry["type"].isin(list("cCsSiIfd"))
            bad = F.when(entry["type"] == "B", F.raise_error(F.lit("an array tag has no value")).cast("string"))
            return tag(F.when(numeric, entry["value"].try_cast("double")), F.coalesce(bad, F.when(~numeric, entry["value"])))
        if name not in kinds:
            return None
        return string(F.col(name)) if kinds[name] == "string" else number(F.col(name))

    return resolve


def alignment_symbols(df: DataFrame) -> Resolver:
    """The symbols of alignment records (qname, flag, rname, refid, pos 0-based, mapq, cigar parsed,
    cigar_text, rnext, mate_refid, mate_pos, tlen, seq, qual, tags, library)."""
    plain = columns_of(df)
    flag = F.col("flag")
    bits = {f"flag.{n.lower()}": 1 << i for i, n in enumerate(FLAG_NAMES)}
    table: dict[str, Callable[[], Value]] = {
        "flag": lambda: number(flag),
        "pos": lambda: number(F.col("pos") + 1),
        "endpos": lambda: number(end_position(F.col("pos"), F.col("cigar"), flag)),
        "mpos": lambda: number(F.col("mate_pos") + 1),
        "pnext": lambda: number(F.col("mate_pos") + 1),
        "mrname": lambda: string(F.col("rnext")),
        "rnext": lambda: string(F.col("rnext")),
        "mrefid": lambda: number(F.col("mate_refid")),
        "cigar": lambda: string(F.col("cigar_text")),
        "ncigar": lambda: number(F.size("cigar")),
        "qlen": lambda: number(query_length(F.col("cigar"))),
        "rlen": lambda: number(reference_length(F.col("cigar"))),
        "library": lambda: string(F.coalesce("library", F.lit(""))),
    }

    def resolve(name: str) -> Value | None:
        if name in bits:
            return number(flag.bitwiseAND(F.lit(bits[name])))
        return table[name]() if name in table else plain(name)

    return resolve


def passing(df: DataFrame, expression: str, resolve: Resolver | None = None) -> DataFrame:
    """Rows for which an expression is true."""
    return df.where(compile_filter(expression, resolve or columns_of(df)))
