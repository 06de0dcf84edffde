"""The query language: a hand-written recursive-descent parser and its tree.

Spaces matter: set and nest operators need them on both sides, ``type:label`` and a stuck comparison (``size:>1GB``) allow none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A query that cannot be read or has no meaning."""


@dataclass(frozen=True)
class Lit:
    text: str
    quoted: bool = False


@dataclass(frozen=True)
class Tag:
    """``type:`` with nothing behind it: the labels of one type."""

    type: str


@dataclass(frozen=True)
class Pattern:
    """``type:pattern:``: labels reduced to the part that the pattern's first star matches."""

    type: str
    pattern: str


@dataclass(frozen=True)
class Typed:
    type: str
    label: Lit


@dataclass(frozen=True)
class Agg:
    fn: str
    body: object = None


@dataclass(frozen=True)
class Calc:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Set:
    op: str  # & | -
    left: object
    right: object


@dataclass(frozen=True)
class Nest:
    left: object
    right: object


@dataclass(frozen=True)
class Compare:
    """A chain of comparisons; label ones (:> and stuck) give items, scalar ones (> ==) a boolean."""

    first: object
    rest: tuple
    scalar: bool


@dataclass(frozen=True)
class Eval:
    body: object


_RESERVED = " \t\r\n&|()\"'=><^,;{}:"
_NOT_IN_TAG_LABEL = " \t\r\n()\"'=><,;{}"
_NUMBER = re.compile(r"-?[0-9]+(?=[ \t\r\n)]|$)")
_WHITE = re.compile(r"[ \t\r\n]*")
_ARITHMETIC = re.compile(r"[ \t\r\n]+([-+*/%])[ \t\r\n]+")
_SET = re.compile(r"[ \t\r\n]+(&|\||-:|-)[ \t\r\n]+")
_NEST = re.compile(r"[ \t\r\n]+&:[ \t\r\n]+")
_LABEL_OP = re.compile(r"[ \t\r\n]+:(=|\^=|<=|>=|\^|>|<)[ \t\r\n]+")
_STUCK_OP = re.compile(r"(<=|>=|\^|>|<)(?![ \t\r\n=])")
_SCALAR_OP = re.compile(r"[ \t\r\n]+(==|\^=|<=|>=|\^|>|<)[ \t\r\n]+")
_AGGREGATE = re.compile(r"(sum|count|avg|max|min)\(")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}
_BINDING = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2}


class _Fail(Exception):
    pass


class Parser:
    def __init__(self, text: str):
        self.text, self.at, self.far = text, 0, 0

    # --- Small steps -------------------------------------------------------------------------------------------------

    def fail(self):
        self.far = max(self.far, self.at)
        raise _Fail

    def take(self, pattern: re.Pattern) -> re.Match:
        m = pattern.match(self.text, self.at)
        if not m:
            self.fail()
        self.at = m.end()
        return m

    def char(self, c: str) -> None:
        if not self.text.startswith(c, self.at):
            self.fail()
        self.at += len(c)

    def white(self) -> None:
        self.at = _WHITE.match(self.text, self.at).end()

    def first(self, *rules):
        """The first rule that matches here."""
        start = self.at
        for rule in rules:
            self.at = start
            try:
                return rule()
            except _Fail:
                self.far = max(self.far, self.at)
        self.at = start
        self.fail()

    def maybe(self, rule):
        start = self.at
        try:
            return rule()
        except _Fail:
            self.at = start
            return None

    def many(self, rule) -> list:
        found = []
        while (x := self.maybe(rule)) is not None:
            found.append(x)
        return found

    def some(self, rule) -> list:
        return [rule(), *self.many(rule)]

    # --- Words -------------------------------------------------------------------------------------------------------

    def raw(self, stop: str) -> str:
        out, at = [], self.at
        while at < len(self.text):
            c = self.text[at]
            if c == "\\" and at + 1 < len(self.text):
                # An escaped pattern character stays escaped, so that it is not taken for a pattern later.
                out.append(self.text[at : at + 2] if self.text[at + 1] in "*?[]\\" else self.text[at + 1])
                at += 2
            elif c in stop:
                break
            else:
                out.append(c)
                at += 1
        if at == self.at:
            self.fail()
        self.at = at
        return "".join(out)

    def quoted(self) -> str:
        q = self.text[self.at : self.at + 1]
        if q not in ('"', "'") or not q:
            self.fail()
        out, at = [], self.at + 1
        while at < len(self.text) and self.text[at] != q:
            if self.text[at] == "\\" and at + 1 < len(self.text):
                c = self.text[at + 1]
                out.append(_ESCAPES.get(c) or ("\\" + c if c in "*?[]" else c))
                at += 2
            else:
                out.append(self.text[at])
                at += 1
        if at >= len(self.text):
            self.fail()
        self.at = at + 1
        return "".join(out)

    def name(self) -> str:
        return self.first(self.quoted, lambda: self.raw(_RESERVED))

    def type_ref(self) -> Tag:
        name = self.name()
        self.char(":")
        return Tag(name)

    def number(self) -> Lit:
        return Lit(self.take(_NUMBER)[0])

    def label(self) -> Lit:
        def plain():
            start = self.at
            if self.maybe(self.type_ref):
                self.at = start
                self.fail()
            return Lit(self.raw(_RESERVED))

        return self.first(lambda: Lit(self.quoted(), True), self.number, plain)

    def tag_label(self) -> Lit:
        return self.first(lambda: Lit(self.quoted(), True), self.number, lambda: Lit(self.raw(_NOT_IN_TAG_LABEL)))

    # --- Arithmetic --------------------------------------------------------------------------------------------------

    def chain(self, operand):
        """operand (op operand)+ with the usual binding, to the left."""
        items = [operand()]

        def step():
            op = self.take(_ARITHMETIC)[1]
            return op, operand()

        for op, x in self.some(step):
            items += [op, x]
        for level in (2, 1):
            out = [items[0]]
            for op, x in zip(items[1::2], items[2::2], strict=True):
                out = [*out[:-1], Calc(op, out[-1], x)] if _BINDING[op] == level else [*out, op, x]
            items = out
        return items[0]

    def inner(self, operand):
        self.white()
        found = self.chain(operand)
        self.white()
        return found

    def paren(self, rule):
        self.char("(")
        self.white()
        found = rule()
        self.white()
        self.char(")")
        return found

    def calculation(self):
        return self.paren(lambda: self.inner(self.calc_operand))

    def calc_operand(self):
        return self.first(self.aggregation, self.type_ref, self.label, self.calculation, lambda: self.paren(self.expr))

    def label_calc(self):
        part = lambda: self.first(self.type_ref, self.label, self.label_calc, lambda: self.paren(self.expr))
        return self.paren(lambda: self.inner(part))

    def scalar_calc(self):
        part = lambda: self.first(self.aggregation, self.label, self.scalar_calc)
        return self.paren(lambda: self.inner(part))

    def aggregation(self) -> Agg:
        fn = self.take(_AGGREGATE)[1]
        self.white()

        def bare():
            found = self.inner(self.calc_operand)
            if not self.text.startswith(")", self.at):
                self.fail()
            return found

        body = None if self.text.startswith(")", self.at) else self.first(bare, self.expr)
        self.white()
        self.char(")")
        if body is None and fn != "count":
            raise QueryError(f"{fn}() needs something to aggregate")
        return Agg(fn, body)

    # --- Sets, nests, comparisons ------------------------------------------------------------------------------------

    def expr(self):
        self.white()
        items = [self.factor()]

        def step():
            op = self.take(_SET)[1]
            return op[0], self.factor()

        for op, x in self.many(step):
            items += [op, x]
        self.white()
        for ops in ("&", "|-"):
            out = [items[0]]
            for op, x in zip(items[1::2], items[2::2], strict=True):
                out = [*out[:-1], Set(op, out[-1], x)] if op in ops else [*out, op, x]
            items = out
        return items[0]

    def factor(self):
        return self.first(self.evaluation, self.label_comparison, self.scalar_comparison, self.nest, self.typed, self.type_ref, self.calculation, self.aggregation, lambda: self.paren(self.expr), self.label)

    def evaluation(self) -> Eval:
        self.char("q(")
        self.white()
        body = self.expr()
        self.white()
        self.char(")")
        return Eval(body)

    def typed(self) -> Typed:
        name = self.name()
        self.char(":")
        return Typed(name, self.tag_label())

    def pattern(self) -> Pattern:
        name = self.name()
        self.char(":")
        pattern = self.first(self.quoted, lambda: self.raw(" \t\r\n:&|()\"'"))
        self.char(":")
        return Pattern(name, pattern)

    def nest(self):
        left = self.first(self.pattern_and, self.pattern, self.type_ref, self.nest_paren, lambda: self.paren(self.expr))

        def step():
            self.take(_NEST)
            return self.first(self.scalar_comparison, self.aggregation, self.type_ref, self.calculation, lambda: self.paren(self.expr), self.label)

        found = left
        for right in self.some(step):
            found = Nest(found, right)
        return found

    def pattern_and(self):
        """( x & type:pattern: & ... ) before a nest operator."""

        def inside():
            part = lambda: self.first(self.pattern, self.factor)
            found = part()

            def step():
                if self.take(_SET)[1] != "&":
                    self.fail()
                return part()

            for x in self.some(step):
                found = Set("&", found, x)
            return found

        return self.paren(inside)

    def nest_paren(self):
        return self.paren(lambda: self.first(self.nest_paren, self.nest))

    def operand(self):
        return self.first(self.evaluation, self.aggregation, self.calculation, self.type_ref, lambda: self.paren(self.expr), self.label)

    def label_comparison(self) -> Compare:
        def step():
            op = self.take(_LABEL_OP)[1]
            return op, self.operand()

        def colon():
            left = self.first(self.nest, self.nest_paren, self.type_ref, self.calculation, self.label_calc)
            return Compare(left, tuple(self.some(step)), False)

        def stuck():
            left = self.first(self.nest, self.nest_paren, self.type_ref, self.label_calc)
            op = self.take(_STUCK_OP)[1]
            right = self.first(lambda: Lit(self.quoted(), True), self.number, self.scalar_calc, lambda: Lit(self.raw(_NOT_IN_TAG_LABEL)))
            return Compare(left, ((op, right), *self.many(step)), False)

        def turned():
            left = self.first(self.number, lambda: Lit(self.quoted(), True), self.label, self.label_calc)
            op = self.take(_LABEL_OP)[1]
            right = self.first(self.type_ref, self.calculation, lambda: self.paren(self.expr))
            return Compare(left, ((op, right), *self.many(step)), False)

        return self.first(colon, stuck, turned)

    def scalar_comparison(self) -> Compare:
        def operand():
            return self.first(self.aggregation, self.scalar_calc, lambda: self.paren(self.expr), self.label)

        left = operand()

        def step():
            op = self.take(_SCALAR_OP)[1]
            return op, operand()

        return Compare(left, tuple(("=" if op == "==" else op, x) for op, x in self.some(step)), True)

    # --- Whole queries -----------------------------------------------------------------------------------------------

    def end(self, found):
        self.white()
        if self.at < len(self.text):
            self.fail()
        return found

    def arithmetic_query(self):
        self.white()
        part = lambda: self.first(self.aggregation, self.number, self.calculation, self.type_ref, lambda: self.paren(self.expr), self.label)
        found = self.end(self.chain(part))
        if not _numeric(found):
            self.fail()
        return found

    def query(self):
        return self.first(self.arithmetic_query, lambda: self.end(self.expr()))


def _numeric(x) -> bool:
    """Whether something can take part in arithmetic: sets of items cannot."""
    if isinstance(x, Calc):
        return _numeric(x.left) and _numeric(x.right)
    if isinstance(x, Nest):
        return True
    if isinstance(x, Set):
        return _numeric(x.left) and x.op == "&" or _numeric(x.right)
    return isinstance(x, (Lit, Tag, Agg))


def parse(text: str):
    """The tree of a query; QueryError tells where reading stopped."""
    parser = Parser(text)
    try:
        return parser.query()
    except _Fail:
        rest = text[parser.far : parser.far + 20]
        hint = ""
        if re.search(r"\w:\s+[<>]", text):
            hint = "; compare labels with :> and the like, or without spaces"
        elif re.search(r"\S[&|]\s|\s[&|]\S", text):
            hint = "; set operators need a space on both sides"
        raise QueryError(f"cannot read the query at {parser.far} ({rest!r}){hint}") from None
    except RecursionError:
        raise QueryError("the query is nested too deeply") from None
