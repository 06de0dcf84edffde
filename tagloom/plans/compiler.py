"""Compiles a query tree to DataFrames.

A set of items is a boolean Column over the wide item table; whatever is not in it (long tags, scalars, group verdicts) is joined as a
column once.  So set operations are boolean logic on one scan, and Catalyst pushes them to the files.  Groups are one groupBy by the
key columns; several aggregates over the same keys share it.  Nothing here looks at data, except q(...) for definitions,
of which it takes a bounded number.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import literals as L
from .catalog import LABELS, Catalog, TagDef
from .syntax import Agg, Calc, Compare, Eval, Lit, Nest, Pattern, QueryError, Set, Tag, Typed, parse

MEMBERS = 100  # listed of each group
TURN = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "^=": "^=", "^": "^"}
EVAL_LIMIT = 10_000  # definitions, or groups by patterns, that q(...) may put into a query as terms
TEXT_SUM = 512 << 20  # characters of a text sum: it is one value, so more of them are an error


@dataclass
class Result:
    kind: str  # items, groups, scalar, boolean, definitions
    df: DataFrame
    warnings: tuple = ()
    types: dict = field(default_factory=dict)  # the tag type that a column's values are shown as


@dataclass(frozen=True, eq=False)
class Found:
    """What an inner query has found, as a set of items: their ids (without keys), or the labels of keys."""

    df: DataFrame
    keys: tuple = ()


@dataclass(frozen=True)
class Spec:
    """A grouping: keys, filters on its items, and what it computes for each group."""

    keys: tuple
    context: tuple = ()
    value: object = None


def numeric(c: Column, kind: str) -> Column:
    return c.cast("int").cast("double") if kind == "boolean" else F.expr("try_cast(NULL as double)") if c is None else c.cast("double") if kind != "string" else c.try_cast("double")


def compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "^": a != b, "^=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def band(c: Column, op: str, b: L.Band) -> Column:
    """A value against an interval: above it means above its end, from it on its start."""
    if b.modulus:
        c = F.try_mod(c, F.lit(b.modulus))
    return {"=": c.between(b.lo, b.hi), "^": (c < b.lo) | (c > b.hi), "^=": (c < b.lo) | (c > b.hi), ">": c > b.hi, ">=": c >= b.lo, "<": c < b.lo, "<=": c <= b.hi}[op]


def slot(c: Column, op: str, s: L.Slot) -> Column:
    """Epoch seconds against calendar fields; order compares the fixed fields, the coarsest first."""
    t = F.timestamp_seconds(c)
    parts = [(getattr(F, n)(t), v) for n, v in s.fields if v is not None]
    same = reduce(lambda a, b: a & b, [x == v for x, v in parts])
    if op == "=":
        return same
    if op in ("^", "^="):
        return ~same
    # Fixed fields before a free one must be equal; the rest is compared in order.
    run = []
    for n, v in reversed(s.fields):
        if v is not None:
            run.insert(0, (getattr(F, n)(t), v))
        elif run:
            break
    lead = [p for p in parts[: len(parts) - len(run)]]
    order = compare(F.struct(*(x.alias(f"f{k}") for k, (x, _) in enumerate(run))), op, F.struct(*(F.lit(v).cast("int").alias(f"f{k}") for k, (_, v) in enumerate(run))))
    return reduce(lambda a, b: a & b, [x == v for x, v in lead], order)


def match_column(c: Column, d: TagDef, op: str, lit: Lit, now) -> Column:
    """A typed column against a literal, read as its type reads it."""
    text = d.interpret(lit.text) if d.interpret else lit.text
    if text == "*" and not lit.quoted:
        return c.isNotNull() if op in ("=", ">=", "<=") else F.lit(False)
    if d.kind == "string":
        pattern = L.is_pattern(text)
        if pattern and op not in ("=", "^", "^="):
            raise QueryError(f"{d.name}: a pattern has no order")
        if pattern:
            hit = c.rlike(L.glob_regex(text))
            return hit if op == "=" else c.isNotNull() & ~hit
        return compare(c, op, F.lit(L.plain(text)))
    if d.kind == "boolean":
        hits = [v for v in (True, False) if __import__("re").match(L.glob_regex(text.lower()).replace(r"\z", r"\Z"), str(v).lower())]
        if not hits and not L.is_pattern(text):
            raise QueryError(f"{d.name}: {text!r} is neither true nor false")
        if op in ("=", "^", "^="):
            found = c.isin(hits) if hits else F.lit(False)
            return found if op == "=" else c.isNotNull() & ~found
        return compare(c.cast("int"), op, F.lit(int(hits[0])))
    if d.name == "item_id" and (b := L.item_id(text)):
        return band(c, op, b)
    if d.date and (b := L.date(text, now)) is not None:
        return slot(c, op, b) if isinstance(b, L.Slot) else band(c, op, b)
    if d.kind == "integer" and (b := L.size(text)) is not None:
        return band(c, op, b)
    n = L.number(text)
    if n is not None:
        return compare(c, op, F.lit(n))
    if d.kind == "double" and "." in text and "*" in text:
        whole, _, part = text.partition(".")
        if part == "*" and (n := L.number(whole)) is not None:
            lo, hi = (n, n + 1) if not whole.startswith("-") else (n - 1, n)
            inside = (c >= lo) & (c < hi) if not whole.startswith("-") else (c > lo) & (c <= hi)
            return {"=": inside, "^": ~inside, "^=": ~inside, ">": c >= hi, ">=": c >= lo, "<": c < lo, "<=": c < hi}[op]
        if whole == "*" and part.isdigit():
            width = 10.0 ** -len(part)
            rest, lo = F.abs(c) % F.lit(1.0), int(part) * width
            inside = (rest >= lo - width / 1000) & (rest < lo + width - width / 1000)
            return {"=": inside, "^": ~inside, "^=": ~inside, ">": rest >= lo + width - width / 1000, ">=": rest >= lo - width / 1000, "<": rest < lo - width / 1000, "<=": rest < lo + width - width / 1000}[op]
    raise QueryError(f"{d.name}: cannot read {text!r} as {'a date' if d.date else d.kind}")


def match_any(d: TagDef, op: str, lit: Lit, now, cols: dict[str, Column] | None = None) -> Column:
    """The long form's typed label columns against a literal: equality in the column of its type, order in both numeric ones."""
    c = cols or {k: F.col(v) for k, v in LABELS.items()}
    if d.kind != "any":
        return match_column(c[d.kind], d, op, lit, now)
    if lit.text == "*" and not lit.quoted:
        return F.lit(op in ("=", ">=", "<="))
    n = None if lit.quoted else L.number(lit.text)
    if n is None and not lit.quoted and (b := L.size(lit.text)) is not None and b.lo == b.hi:
        n = b.lo
    if n is not None:
        if op == "=":
            return c["integer" if isinstance(n, int) else "double"] == n
        if op in ("^", "^="):
            return F.coalesce(~(c["integer" if isinstance(n, int) else "double"] == n), F.lit(True))
        return F.coalesce(compare(c["integer"], op, F.lit(n)), F.lit(False)) | F.coalesce(compare(c["double"], op, F.lit(n)), F.lit(False))
    if not lit.quoted and lit.text in ("true", "false") and op == "=":
        return F.coalesce(c["boolean"] == (lit.text == "true"), F.lit(False)) | F.coalesce(c["string"] == lit.text, F.lit(False))
    return match_column(c["string"], replace(d, kind="string"), op, lit, now)


class Space:
    """The item table, and the columns that parts of one query join to it."""

    def __init__(self, engine: Engine):
        self.engine, self.catalog, self.frame, self.n = engine, engine.catalog, engine.catalog.items, 0
        self.known: dict = {}

    def _name(self) -> str:
        self.n += 1
        return f"__j{self.n}"

    def flag(self, ids: DataFrame) -> Column:
        """Whether an item is among ids (item_id)."""
        name = self._name()
        self.frame = self.frame.join(ids.select("item_id").distinct().withColumn(name, F.lit(True)), "item_id", "left")
        return F.col(name).isNotNull()

    def lookup(self, keys: list[Column], groups: DataFrame) -> Column:
        """The last column of groups, whose others are the keys, on every item: groups are joined to the items, not to another scan of them."""
        names, got = [self._name() for _ in keys], self._name()
        rows = groups.toDF(*names, got)
        self.frame = self.frame.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True))).join(rows, names, "left").drop(*names)
        return F.col(got)

    def verdict(self, keys: list[Column], groups: DataFrame) -> Column:
        """Whether an item's keys are among the rows of groups."""
        return self.lookup(keys, groups.distinct().withColumn("__hit", F.lit(True))).isNotNull()

    def scalar(self, one: DataFrame) -> Column:
        """The value of a one-row table, on every item."""
        name = self._name()
        self.frame = self.frame.crossJoin(F.broadcast(one.select(F.col("value").alias(name))))
        return F.col(name)

    def rows(self, name: str) -> DataFrame:
        """The long rows of a type; of an item without any, those of the type that it is read from."""
        tags = self.catalog.tags
        if tags is None:
            tags = self.engine.empty_tags()
        own, d = tags.where(F.col("type") == name), self.catalog.get(name)
        if not d.read:
            return own
        other = self.catalog.get(d.read)
        if other.column:
            label = lambda k, n: (F.col(other.column) if k == other.kind else F.lit(None)).cast({"integer": "long"}.get(k, k)).alias(n)
            rest = self.catalog.items.where(F.col(other.column).isNotNull()).select("item_id", F.lit(name).alias("type"), *(label(k, n) for k, n in LABELS.items()))
        else:
            rest = tags.where(F.col("type") == d.read).withColumn("type", F.lit(name))
        return own.unionByName(rest.join(own.select("item_id"), "item_id", "left_anti").select(*own.columns))

    def value(self, name: str, how: str = "max") -> tuple[Column, str]:
        """One label of a type for each item, and its kind; of several the largest (or least)."""
        d = self.catalog.get(name)
        if d.column:
            return F.col(d.column), d.kind
        if (name, how) not in self.known:
            kind = self.engine.kind_of(d)
            got = self._name()
            one = self.rows(name).groupBy("item_id").agg(getattr(F, how)(LABELS[kind]).alias(got)).where(F.col(got).isNotNull())
            self.frame = self.frame.join(one, "item_id", "left")
            self.known[name, how] = F.col(got), kind
        return self.known[name, how]


class Engine:
    """Runs queries over a catalog: ``Engine(catalog).query(text)``."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.warnings = catalog, []

    # --- Entry -------------------------------------------------------------------------------------------------------

    def query(self, text: str, n: int = 0, offset: int = 0, order: tuple = (), members: bool = False, sort: bool = False) -> Result:
        """n = 0 gives everything, unordered; with n, an order or sort, rows come by the order, then by rank and id, both falling."""
        self.warnings = []
        tree = parse(text)
        node = self.expand(tree)
        if isinstance(tree, Calc) and isinstance(node, Lit):
            one, kind = self.scalar(node)
            return Result("scalar", one.select("value", F.lit(kind).alias("bitical_type")))
        sort = bool(sort or n or offset or order)
        found = self.run(node, members, order)
        df = found.df
        if found.kind == "items" and sort:
            df = self.ordered(df, order)
        elif found.kind == "groups" and sort:
            df = df.orderBy(*[F.col(c).asc() for c in reversed([c for c in df.columns if c.startswith("key")])])
        elif found.kind == "definitions" and sort and isinstance(tree, Typed) and tree.type == "type":
            # Types alone come by their items, the latest first, like their own order says.
            df = df.orderBy(F.desc_nulls_last("item_id"), F.desc("rank"), F.asc_nulls_last("name"))
        elif found.kind == "definitions" and sort:
            df = df.orderBy(F.desc("rank"), F.asc_nulls_last("name"), F.desc_nulls_last("item_id"))
        if offset:
            df = df.offset(offset)
        if n:
            df = df.limit(n)
        return Result(found.kind, df, tuple(self.warnings), self.shown_as(node, found))

    def shown_as(self, node, found: Result) -> dict:
        """Key columns show as their types; a value as that of the labels which it is one of, or the sum of."""
        if found.kind != "groups" or isinstance(node, Set) and sum(map(self.has_groups, flat(node, node.op))) > 1 or isinstance(node, (Calc, Tag)) or isinstance(node, Nest) and self._nest_or(node):
            return {"key0": node.type} if isinstance(node, Tag) else {}
        s = self.spec(node)
        out = {f"key{i}": k.type for i, k in enumerate(s.keys) if isinstance(k, Tag)}
        if isinstance(s.value, Agg) and s.value.fn != "count" and isinstance(target := self.split(s.value.body)[1], Tag):
            out["nvalue"] = target.type
        return out

    def page(self, text: str, n: int = 100, offset: int = 0, order: tuple = ()) -> tuple[list, bool]:
        """A page of rows, and whether there are more: one row more is fetched to know."""
        rows = self.query(text, n + 1, offset, order).df.collect()
        return rows[:n], len(rows) > n

    def ordered(self, df: DataFrame, order: tuple) -> DataFrame:
        """df by the columns __o0, __o1, ... that run() has put beside the items."""
        keys, drop = [], []
        for k, (name, desc) in enumerate(order):
            c = F.col(name if name in ("rank", "item_id") else f"__o{k}")
            drop += [f"__o{k}"] * (name not in ("rank", "item_id"))
            keys.append(c.desc_nulls_last() if desc else c.asc_nulls_last())
        return df.orderBy(*keys, F.desc("rank"), F.desc("item_id")).drop(*drop)

    def run(self, node, members: bool = False, order: tuple = ()) -> Result:
        if self.is_definition(node):
            return Result("definitions", self.definitions(node))
        if isinstance(node, Compare) and node.scalar or isinstance(node, Compare) and self.is_scalar(node.first) and all(self.is_scalar(x) for _, x in node.rest):
            return Result("boolean", self.boolean(node))
        if self.is_scalar(node) and not isinstance(node, Lit):
            df, kind = self.scalar(node)
            return Result("scalar", df.select("value", F.lit(kind).alias("bitical_type")))
        if self.has_groups(node):
            return self.groups(node, members)
        space = Space(self)
        cond = self.items(node, space)
        by = [space.value(name)[0].alias(f"__o{k}") for k, (name, _) in enumerate(order) if name not in ("rank", "item_id")]
        return Result("items", space.frame.where(cond).select("item_id", "rank", "item_kind", *by))

    def empty_tags(self) -> DataFrame:
        from .catalog import TAG_COLUMNS

        return self.catalog.items.sparkSession.createDataFrame([], TAG_COLUMNS)

    def kind_of(self, d: TagDef) -> str:
        return "string" if d.kind == "any" else d.kind

    # --- Expansion ---------------------------------------------------------------------------------------------------

    def expand(self, node):
        """Chains become pairs, types' macros and q(...) are put in, constants are folded, aggregates move into nests."""
        if isinstance(node, Typed):
            d = self.catalog.get(node.type)
            if d.expand:
                return self.expand(parse(d.expand(node.label.text)))
            if d.implies and node.label.text != "*":
                return Set("&", node, parse(d.implies))
            return node
        if isinstance(node, Tag):
            d = self.catalog.get(node.type)
            return self.expand(parse(d.expand_projection)) if d.expand_projection else node
        if isinstance(node, Set):
            return Set(node.op, self.expand(node.left), self.expand(node.right))
        if isinstance(node, Nest):
            if isinstance(node.left, (Calc, Lit, Agg)):
                raise QueryError("a nest needs labels on its left")
            return Nest(self.expand(node.left), self.expand(node.right))
        if isinstance(node, Calc):
            return self.fold(Calc(node.op, self.expand(node.left), self.expand(node.right)))
        if isinstance(node, Compare):
            if any(isinstance(x, Lit) and x.text.endswith(":") and not x.quoted for _, x in node.rest):
                self.warnings.append("what stands right of a stuck comparison is a text, not a projection")
            sides = [self.expand(node.first), *(self.expand(x) for _, x in node.rest)]
            pairs = [self.rewritten(Compare(a, ((op, b),), node.scalar)) for a, (op, _), b in zip(sides, node.rest, sides[1:], strict=False)]
            return reduce(lambda a, b: Set("&", a, b), pairs)
        if isinstance(node, Agg):
            body = self.expand(node.body) if node.body is not None else None
            if isinstance(body, Agg) and not isinstance(body.body, Nest) or isinstance(body, Calc) and not _nests(body) and all(isinstance(x, (Agg, Lit)) for x in _leaves(body)) and _aggs(body):
                raise QueryError(f"{node.fn}(...) over a single value")
            if isinstance(body, Nest) and not isinstance(body.right, (Agg, Compare, Lit)) and not _aggs(body.right):
                # One level: the aggregate of a nest of labels is a nest of aggregates.
                return Nest(body.left, Agg(node.fn, body.right))
            return Agg(node.fn, body)
        if isinstance(node, Eval):
            return self.evaluate(node)
        return node

    def rewritten(self, x: Compare):
        """A comparison as the type of its projection would have it."""
        a, (op, b) = x.first, x.rest[0]
        if isinstance(a, Lit) and isinstance(b, Tag):
            a, op, b = b, TURN[op], a
        d = self.catalog.get(a.type) if isinstance(a, Tag) and isinstance(b, Lit) else None
        text = d.rewrite(op, b.text) if d and d.rewrite else None
        return x if text is None else self.expand(parse(text))

    def fold(self, node: Calc):
        """Constants: whole numbers stay whole (division truncates), others are doubles, texts join."""
        a, b = node.left, node.right
        if not (isinstance(a, Lit) and isinstance(b, Lit)):
            return node
        x, y = (None if t.quoted else L.number(t.text) for t in (a, b))
        x, y = (v if v is not None else (z.lo if not t.quoted and (z := L.size(t.text)) and z.lo == z.hi else None) for v, t in ((x, a), (y, b)))
        if x is None or y is None:
            if x is None and y is None and node.op in "+*":
                return Lit(a.text + (", " if node.op == "+" else "") + b.text, True)
            raise QueryError("arithmetic mixes text and numbers")
        if node.op in "/%" and y == 0:
            raise QueryError("division by zero")
        if isinstance(x, int) and isinstance(y, int):
            q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1) if y else 0
            v = {"+": x + y, "-": x - y, "*": x * y, "/": q, "%": x - q * y}[node.op]
            if not -(2**63) <= v < 2**63:
                raise QueryError("the number is too large")
            return Lit(str(v))
        v = {"+": x + y, "-": x - y, "*": x * y, "/": x / y if y else 0.0, "%": float(__import__("math").fmod(x, y)) if y else 0.0}[node.op]
        return Lit(repr(float(v)))

    def evaluate(self, node: Eval):
        """q(...): the inner result as a set of items. Items, and the labels of plain keys, are joined; the rest becomes terms."""
        body = self.expand(node.body)
        inner = self.run(body)
        if inner.kind in ("scalar", "boolean"):
            v = inner.df.head()["value"]
            return Lit(format(Decimal(repr(v)), "f") if isinstance(v, float) else str(v), isinstance(v, str))
        terms = []
        if inner.kind == "groups":
            sets = isinstance(body, Set) and (body.op == "|" or sum(map(self.has_groups, flat(body, body.op))) > 1)
            keys = () if sets or isinstance(body, Tag) and body.type == "type" or isinstance(body, Nest) and self._nest_or(body) else self.spec(body).keys
            long_ = [k for k in keys if isinstance(k, Tag) and not self.catalog.get(k.type).column]
            if keys and all(isinstance(k, Tag) for k in keys) and (not long_ or len(keys) == 1 and self.catalog.get(keys[0].type).kind != "any"):
                return Found(inner.df.select(*(f"key{i}" for i in range(len(keys)))), keys)
            keys = self.spec(body).keys
            for r in self._few(inner.df):
                terms.append(reduce(lambda a, b: Set("&", a, b), [Typed(k.type, Lit(str(r[f"key{i}"]), True)) for i, k in enumerate(keys)]))
        elif inner.kind == "definitions":
            terms = [self._defined(r) for r in self._few(inner.df)]
        else:
            ids, stored = inner.df.select("item_id"), self.catalog.definitions
            if stored is None:
                return Found(ids)
            # Stored types and tags stand for the items that carry them, not for themselves.
            own = stored.where("item_kind IN ('tag', 'type')")
            terms = [self._defined(r) for r in self._few(own.join(ids, "item_id", "left_semi"))]
            return _balanced("|", [Found(ids.join(own.select("item_id"), "item_id", "left_anti")), *terms])
        return _balanced("|", terms) if terms else Set("-", Typed("*", Lit("*")), Typed("*", Lit("*")))

    def _few(self, df: DataFrame) -> list:
        rows = df.limit(EVAL_LIMIT + 1).collect()
        if len(rows) > EVAL_LIMIT:
            raise QueryError(f"q(...) found more than {EVAL_LIMIT} definitions or groups by patterns")
        return rows

    def _defined(self, r) -> Typed:
        kind, _, label = r["name"].partition(":")
        return Typed(kind, Lit(label, True)) if r["item_kind"] == "tag" else Typed(kind, Lit("*"))

    def found(self, x: Found, space: Space) -> Column:
        """Whether an item is one of those found, or has the labels found."""
        if not x.keys:
            return space.flag(x.df)
        if len(x.keys) == 1 and not self.catalog.get(x.keys[0].type).column:
            label = LABELS[self.kind_of(self.catalog.get(x.keys[0].type))]
            return space.flag(space.rows(x.keys[0].type).join(x.df.select(F.col("key0").alias(label)), label, "left_semi"))
        return space.verdict([self.number(k, space)[0] for k in x.keys], x.df)

    # --- What a node is ----------------------------------------------------------------------------------------------

    def is_scalar(self, x) -> bool:
        if isinstance(x, (Lit, Agg)):
            return True
        return isinstance(x, Calc) and self.is_scalar(x.left) and self.is_scalar(x.right)

    def has_groups(self, x) -> bool:
        """Whether a node gives groups at top level."""
        if isinstance(x, (Tag, Pattern)):
            return True
        if isinstance(x, Calc):
            return not self.is_scalar(x)
        if isinstance(x, Nest):
            return not self.nest_is_items(x)
        if isinstance(x, Set):
            a, b = self.has_groups(x.left), self.has_groups(x.right)
            return a or b if x.op == "&" else a if x.op == "-" else a and b and self.unions(x)
        return False

    def unions(self, x: Set) -> bool:
        """Whether an or of projections stays one: all have one key, or the same keys."""
        specs = [self.spec(y) for y in flat(x, "|")] if all(self.has_groups(y) for y in flat(x, "|")) else []
        if not specs or any(s.value is not None for s in specs):
            return False
        return all(len(s.keys) == 1 for s in specs) or len({s.keys for s in specs}) == 1

    def nest_is_items(self, x: Nest) -> bool:
        return isinstance(self.spec(x).value, (Compare, Set)) if not self._nest_or(x) else False

    def _nest_or(self, x: Nest) -> bool:
        return isinstance(x.right, Set) and x.right.op == "|"

    def spec(self, x) -> Spec:
        """The grouping that a node stands for."""
        if isinstance(x, Tag):
            return Spec(() if x.type == "*" else (x,))
        if isinstance(x, Pattern):
            return Spec((x,))
        if isinstance(x, Calc) and not _aggs(x):
            return Spec((x,))
        if isinstance(x, (Agg, Lit)) or isinstance(x, Calc):
            return Spec((), (), x)
        if isinstance(x, Compare):
            return Spec((), (), x) if x.scalar or _aggs(x) else Spec((), (x,))
        if isinstance(x, Set) and x.op == "&":
            parts = flat(x, "&")
            if all(isinstance(p, Compare) and p.scalar for p in parts):
                return Spec((), (), x)
            specs = [self.spec(p) for p in parts]
            values = [s.value for s in specs if s.value is not None]
            if len(values) > 1:
                raise QueryError("several values for one grouping")
            return Spec(_unique(k for s in specs for k in s.keys), tuple(c for s in specs for c in s.context), values[0] if values else None)
        if isinstance(x, Set) and x.op == "-" and self.has_groups(x.left):
            left = self.spec(x.left)
            return replace(left, context=(*left.context, Set("-", Typed("*", Lit("*")), x.right)))
        if isinstance(x, Nest):
            left, right = self.spec(x.left), self.spec(x.right)
            if left.value is not None:
                raise QueryError("a computed value cannot be grouped further")
            return Spec(_unique((*left.keys, *right.keys)), (*left.context, *right.context), right.value)
        return Spec((), (x,))

    # --- Items -------------------------------------------------------------------------------------------------------

    def items(self, x, space: Space) -> Column:
        """Whether an item is in the set of a node; never null."""
        return F.coalesce(self._items(x, space), F.lit(False))

    def _items(self, x, space: Space) -> Column:
        if isinstance(x, Set):
            if self.is_scalar(x.left) and not isinstance(x.left, Lit) or self.is_scalar(x.right) and not isinstance(x.right, Lit):
                raise QueryError("a single value is no set of items")
            if x.op == "|":
                return self.any_of(flat(x, "|"), space)
            a, b = self.items(x.left, space), self.items(x.right, space)
            return a & b if x.op == "&" else a & ~b
        if isinstance(x, Lit):
            return self.match("*", "=", x, space)
        if isinstance(x, Found):
            return self.found(x, space)
        if isinstance(x, Typed):
            return self.match(x.type, "=", x.label, space)
        if isinstance(x, (Tag, Pattern)):
            return self.exists(x, space)
        if isinstance(x, Compare):
            return self.compared(x, space)
        if isinstance(x, Nest):
            if self._nest_or(x):
                return reduce(lambda a, b: a | b, [self.items(Nest(x.left, y), space) for y in flat(x.right, "|")])
            s = self.spec(x)
            if isinstance(s.value, (Compare, Set)):
                return self.group_filter(s, s.value, space)
            return reduce(lambda a, b: a & b, [self.items(c, space) for c in (*s.context, *s.keys)], F.lit(True))
        if isinstance(x, Calc):
            return self.number(x, space)[0].isNotNull()
        raise QueryError(f"no set of items: {type(x).__name__}")

    def any_of(self, parts: list, space: Space) -> Column:
        """An or; matches of the same long type share one pass over its rows."""
        by, rest = {}, []
        for p in parts:
            if isinstance(p, Typed) and not L.is_pattern(p.type) and not self.catalog.get(p.type).column and p.type not in ("type", "tag", "label", "origin"):
                by.setdefault(p.type, []).append(p)
            else:
                rest.append(self.items(p, space))
        for name, same in by.items():
            d = self.catalog.get(name)
            hit = reduce(lambda a, b: a | b, [F.coalesce(match_any(d, "=", p.label, self.catalog.now), F.lit(False)) for p in same])
            rest.append(space.flag(space.rows(name).where(hit)))
        return reduce(lambda a, b: a | b, rest)

    def match(self, name: str, op: str, lit: Lit, space: Space) -> Column:
        c, now = self.catalog, self.catalog.now
        if name == "origin":
            from ..functions.ids import origin_of

            want = ["builtin", "file", "plugin"] if lit.text == "system" else [lit.text]
            hit = origin_of(F.col("item_id")).isin(want)
            return hit if op == "=" else ~hit
        if name == "label":
            name = "*"
        if L.is_pattern(name):
            if name == "*" and lit.text == "*" and not lit.quoted:
                return F.lit(op == "=")
            hits = []
            regex = L.glob_regex(name)
            plain = __import__("re").compile(regex.replace(r"\z", r"\Z"))
            for d in c.defs.values():
                if d.column and plain.match(d.name):
                    try:
                        hits.append(F.coalesce(match_column(F.col(d.column), d, op, lit, now), F.lit(False)))
                    except QueryError:
                        continue  # a literal that this type cannot hold
            if c.tags is not None:
                rows = c.tags if name == "*" else c.tags.where(F.col("type").rlike(regex))
                hits.append(space.flag(rows.where(match_any(TagDef(name, "any"), op, lit, now))))
            return reduce(lambda a, b: a | b, hits, F.lit(False))
        d = c.get(name)
        if d.column:
            return match_column(F.col(d.column), d, op, lit, now)
        return space.flag(space.rows(name).where(match_any(d, op, lit, now)))

    def exists(self, x, space: Space) -> Column:
        if isinstance(x, Pattern):
            c, kind = space.value(x.type)
            return _grouped(c, kind, x).isNotNull()
        if x.type == "*":
            return F.lit(True)
        d = self.catalog.get(x.type)
        return F.col(d.column).isNotNull() if d.column else space.flag(space.rows(x.type))

    def compared(self, x: Compare, space: Space) -> Column:
        a, (op, b) = x.first, x.rest[0]
        if isinstance(a, Lit) and not isinstance(b, Lit):
            a, b, op = b, a, TURN[op]
        if isinstance(b, Lit) and isinstance(a, (Tag, Typed, Pattern)):
            return self.match(a.type, op, b, space)
        nests = [y for side in (a, b) for y in _nests(side)]
        if nests:
            if not all(isinstance(y, (Nest, Lit, Calc)) for y in (a, b)):
                raise QueryError("a grouping compares with numbers, arithmetic or another grouping")
            specs = {self.spec(n).keys for n in nests}
            if len(specs) > 1:
                return self.across(a, op, b, space)
            s = self.spec(nests[0])
            return self.group_filter(Spec(s.keys, (), None), Compare(a, ((op, b),), True), space)
        if self.is_scalar(a) and self.is_scalar(b):
            return space.scalar(self.boolean(x).select("value"))
        return self._compare_values(a, op, b, space)

    def _compare_values(self, a, op: str, b, space: Space) -> Column:
        """Two values of each item: numbers as doubles, texts as texts."""
        (u, uk), (v, vk) = self.number(a, space), self.number(b, space)
        if "string" in (uk, vk):
            if uk != vk:
                raise QueryError("a comparison mixes text and numbers")
            return compare(u, op, v)
        return compare(numeric(u, uk), op, numeric(v, vk))

    def number(self, x, space: Space) -> tuple[Column, str]:
        """A value of each item, and its kind."""
        if isinstance(x, Tag):
            return space.value(x.type)
        if isinstance(x, Pattern):
            c, kind = space.value(x.type)
            return _grouped(c, kind, x), "string"
        if isinstance(x, Lit):
            n = None if x.quoted else L.number(x.text)
            if n is None and not x.quoted and (b := L.size(x.text)) and b.lo == b.hi:
                n = b.lo
            return (F.lit(n), "integer" if isinstance(n, int) else "double") if n is not None else (F.lit(x.text), "string")
        if isinstance(x, Agg):
            df, kind = self.scalar(x)
            return space.scalar(df), {"numeric": "double"}.get(kind, kind)
        if isinstance(x, Set) and x.op == "&":
            parts = flat(x, "&")
            tags = [p for p in parts if isinstance(p, (Tag, Calc))]
            if len(tags) != 1:
                raise QueryError("arithmetic needs one projection")
            c, kind = self.number(tags[0], space)
            for p in parts:
                if p is not tags[0]:
                    c = F.when(self.items(p, space), c)
            return c, kind
        if isinstance(x, Calc):
            (a, ak), (b, bk) = self.number(x.left, space), self.number(x.right, space)
            return _arithmetic(x.op, a, ak, b, bk)
        raise QueryError(f"no value of an item: {type(x).__name__}")

    # --- Groups ------------------------------------------------------------------------------------------------------

    def keyed(self, keys: tuple, context: tuple, space: Space) -> tuple[DataFrame, list[str]]:
        """Items with their key columns; an item with several labels of a single long key comes once for each."""
        conds = [self.items(c, space) for c in context]
        names = [f"key{i}" for i in range(len(keys))]
        k = keys[0] if len(keys) == 1 else None
        if isinstance(k, (Tag, Pattern)) and not self.catalog.get(k.type).column and k.type != "type":
            kind = self.kind_of(self.catalog.get(k.type))
            label = _grouped(F.col(LABELS[kind]), kind, k) if isinstance(k, Pattern) else F.col(LABELS[kind]) if self.catalog.get(k.type).kind != "any" else F.coalesce("label_str", F.col("label_int").cast("string"), F.col("label_double").cast("string"), F.col("label_bool").cast("string"))
            rows = space.rows(k.type).select("item_id", label.alias("key0")).where("key0 IS NOT NULL").distinct()
            space.frame = space.frame.join(rows, "item_id")
        else:
            columns = [self.number(k, space)[0] for k in keys]
            space.frame = space.frame.select("*", *(c.alias(n) for c, n in zip(columns, names, strict=True)))
        # Conditions over columns that were joined before stay valid: names are kept.
        cond = reduce(lambda a, b: a & b, [*conds, *(F.col(n).isNotNull() for n in names)], F.lit(True))
        return cond, names

    def aggregate(self, x: Agg, space: Space, grouped: bool) -> tuple[Column, str, Column | None]:
        """An aggregate over items: its column, kind, and which items it counts."""
        where, target = self.split(x.body)
        if x.fn == "count" and isinstance(target, Tag) and target.type == "type":
            raise QueryError("count(type:) is no aggregate of items")
        hit = reduce(lambda a, b: a & b, [self.items(w, space) for w in where]) if where else None
        if target is None:
            if x.fn != "count":
                return F.lit(None).cast("double"), "numeric", hit
            c = F.count(F.when(hit, 1)) if hit is not None else F.count(F.lit(1))
            return c, "integer", hit
        if x.fn == "count":
            if isinstance(target, Tag) and not self.catalog.get(target.type).column and not grouped:
                kind = self.kind_of(self.catalog.get(target.type))
                space.frame = space.frame.join(space.rows(target.type).select("item_id", F.col(LABELS[kind]).alias("__label")), "item_id", "left")
                c = F.col("__label")
            else:
                c, kind = self.number(target, space)
            c = F.when(hit, c) if hit is not None else c
            return F.countDistinct(c), "integer", c.isNotNull()
        c, kind = space.value(target.type, "min") if isinstance(target, Tag) else self.number(target, space)
        c = F.when(hit, c) if hit is not None else c
        if kind == "boolean":
            c, kind = c.cast("int"), "integer"
        if kind == "string" and x.fn in ("sum", "avg"):
            if x.fn == "avg":
                return F.lit(None).cast("double"), "numeric", c.isNotNull()
            size = F.coalesce(F.sum(F.length(c) + 2), F.lit(0))
            whole = F.array_join(F.sort_array(F.collect_list(c)), ", ")
            return F.when(size <= TEXT_SUM, whole).otherwise(F.raise_error(F.lit(f"a text sum of over {TEXT_SUM} characters")).cast("string")), "string", c.isNotNull()
        return getattr(F, x.fn)(c), "double" if x.fn == "avg" else kind, c.isNotNull()

    def split(self, body) -> tuple[list, object]:
        """Filters and the projection of an aggregate's body."""
        if body is None:
            return [], None
        parts = flat(body, "&") if isinstance(body, Set) and body.op == "&" else [body]
        targets = [p for p in parts if isinstance(p, (Tag, Pattern, Calc)) and not (isinstance(p, Tag) and p.type == "*")]
        rest = [p for p in parts if p not in targets and not (isinstance(p, Tag) and p.type == "*")]
        if len(targets) > 1:
            rest += targets[1:]
        return rest, targets[0] if targets else None

    def table(self, s: Spec, members: bool = False) -> tuple[DataFrame, list[str]]:
        """One row a group: keys, nvalue (with a value), item_count."""
        space = Space(self)
        cond, names = self.keyed(s.keys, s.context, space)
        aggs, out = [], {}
        value = s.value
        if isinstance(value, Lit):
            out["nvalue"] = F.lit(L.number(value.text)).cast("double") if L.number(value.text) is not None else F.lit(value.text)
        elif value is not None:
            terms = {}

            def term(a: Agg):
                if a not in terms:
                    if isinstance(a.body, Nest):
                        raise QueryError("a grouping inside a group's aggregate")
                    c, kind, hit = self.aggregate(a, space, True)
                    name = f"__a{len(terms)}"
                    aggs.append(c.alias(name))
                    aggs.append(F.count(F.when(hit, 1) if hit is not None else F.lit(1)).alias(name + "n"))
                    terms[a] = F.col(name), kind, name
                return terms[a]

            v, kind = self._value(value, term)
            out["nvalue"] = v if kind == "string" else v.cast("double")
            first = next(iter(terms.values()), None)
            if first and (len(s.keys) == 1 or value is not None and not (isinstance(value, Agg) and value.fn == "count")):
                out["__keep"] = F.col(first[2] + "n") > 0
        rows = space.frame.where(cond)
        g = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("item_count"), *aggs)
        if "__keep" in out:
            g = g.where(out.pop("__keep"))
        g = g.select(*names, *(c.alias(n) for n, c in out.items()), "item_count")
        if members:
            # The first of each group in two steps, so a large group is not sorted in one task.
            salt = F.pmod(F.xxhash64("item_id"), F.lit(64))
            order = [F.desc("rank"), F.desc("item_id")]
            top = rows.select(*names, "item_id", "rank", salt.alias("__s")).withColumn("__n", F.row_number().over(Window.partitionBy(*names, "__s").orderBy(*order))).where(F.col("__n") <= MEMBERS)
            top = top.withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where(F.col("__n") <= MEMBERS)
            lists = top.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "item_id"))), lambda m: m["item_id"]).alias("members"))
            g = g.join(lists, names)
        return g, names

    def _value(self, x, term) -> tuple[Column, str]:
        if isinstance(x, Agg):
            c, kind, _ = term(x)
            return c, "double" if kind == "numeric" else kind
        if isinstance(x, Lit):
            n = L.number(x.text) if not x.quoted else None
            if n is None and not x.quoted and (b := L.size(x.text)):
                n = b.lo
            return (F.lit(n), "double") if n is not None else (F.lit(x.text), "string")
        if isinstance(x, Calc):
            (a, ak), (b, bk) = self._value(x.left, term), self._value(x.right, term)
            return _arithmetic(x.op, a, ak, b, bk)
        raise QueryError(f"no value of a group: {type(x).__name__}")

    def groups(self, x, members: bool) -> Result:
        if isinstance(x, Calc):
            nests = _nests(x)
            if not nests:
                return Result("groups", self.table(Spec((x,)), members)[0])
            return Result("groups", self.nest_arithmetic(x))
        if isinstance(x, Nest) and self._nest_or(x):
            return self.groups(reduce(lambda a, b: Set("|", a, b), [self.expand(Nest(x.left, y)) for y in flat(x.right, "|")]), members) if self.unions(reduce(lambda a, b: Set("|", a, b), [Nest(x.left, y) for y in flat(x.right, "|")])) else Result("groups", self.union_groups([self.spec(Nest(x.left, y)) for y in flat(x.right, "|")]))
        if isinstance(x, Set):
            parts = flat(x, x.op)
            proj = [p for p in parts if self.has_groups(p)]
            if x.op == "&" and len(proj) > 1 and all(isinstance(p, Tag) for p in proj):
                self.warnings.append("projections joined by & meet in their labels; &: groups by both")
            if x.op == "|" or x.op == "&" and len(proj) > 1 or x.op == "-" and len(proj) > 1:
                return Result("groups", self.label_sets(x.op, parts))
        if isinstance(x, Tag) and x.type == "type":
            return Result("groups", self.type_projection())
        return Result("groups", self.table(self.spec(x), members)[0])

    def union_groups(self, specs: list[Spec]) -> DataFrame:
        """Groupings with different keys, one below the other; keys as texts."""
        width = max(len(s.keys) for s in specs)
        out = []
        for s in specs:
            g, names = self.table(s)
            out.append(g.select(*(_text(F.col(names[i]), g.schema[names[i]].dataType).alias(f"key{i}") if i < len(names) else F.lit(None).cast("string").alias(f"key{i}") for i in range(width)), "item_count"))
        return reduce(lambda a, b: a.unionByName(b), out)

    def type_projection(self) -> DataFrame:
        """type: the types in use and how many items have each, with the fixed attributes."""
        wide = [d for d in self.catalog.defs.values() if d.column]
        counts = self.catalog.items.agg(F.count(F.lit(1)).alias("__all"), *(F.count(d.column).alias(d.name) for d in wide))
        fixed = ("item_id", "item_kind", "rank", "origin")
        pairs = F.array(*(F.struct(F.lit(d.name).alias("key0"), F.col(f"`{d.name}`").alias("item_count")) for d in wide), *(F.struct(F.lit(n).alias("key0"), F.col("__all").alias("item_count")) for n in fixed))
        out = counts.select(F.inline(pairs)).where("item_count > 0")
        if self.catalog.tags is not None:
            long_ = self.catalog.tags.groupBy(F.col("type").alias("key0")).agg(F.countDistinct("item_id").alias("item_count"))
            out = out.unionByName(long_).groupBy("key0").agg(F.max("item_count").alias("item_count"))
        return out

    def labels(self, s: Spec) -> DataFrame:
        """(label, item_id) of a grouping: a struct of typed columns for each key, so that 1 and "1" differ."""
        space = Space(self)
        conds = [self.items(c, space) for c in s.context]
        if len(s.keys) == 1 and isinstance(s.keys[0], Tag) and not self.catalog.get(s.keys[0].type).column:
            rows = space.rows(s.keys[0].type).select("item_id", F.array(F.struct(*(F.col(c) for c in LABELS.values()))).alias("label"))
            space.frame = space.frame.join(rows.distinct(), "item_id")
            return space.frame.where(reduce(lambda a, b: a & b, conds, F.lit(True))).select("label", "item_id")
        values = [self.number(k, space) for k in s.keys]
        label = F.array(*(F.struct(*((c if k == kind else F.lit(None)).cast({"integer": "long"}.get(k, k)).alias(n) for k, n in LABELS.items())) for c, kind in values))
        cond = reduce(lambda a, b: a & b, [*conds, *(c.isNotNull() for c, _ in values)], F.lit(True))
        return space.frame.where(cond).select(label.alias("label"), "item_id")

    def label_sets(self, op: str, parts: list) -> DataFrame:
        """Set operations on labels: the labels that remain, with all items of the operands that carry them."""
        if op == "-":
            left, rest = parts[0], parts[1:]
            s = self.spec(left)
            if len(s.keys) > 1:
                return self.table(replace(s, context=(*s.context, *(Set("-", Typed("*", Lit("*")), r) for r in rest))))[0]
            plain = [r for r in rest if not self.has_groups(r)]
            rows = self.labels(replace(s, context=(*s.context, *(Set("-", Typed("*", Lit("*")), r) for r in plain))))
            for r in rest:
                if r not in plain:
                    rows = rows.join(self.labels(self.spec(r)).select("label").distinct(), "label", "left_anti")
        else:
            filters = tuple(p for p in parts if not self.has_groups(p))
            specs = [self.spec(p) for p in parts if self.has_groups(p)]
            tables = [self.labels(replace(s, context=(*s.context, *filters))) for s in specs]
            rows = reduce(lambda a, b: a.unionByName(b), tables)
            if op == "&":
                if len({len(s.keys) for s in specs}) == 1 and len(specs[0].keys) > 1 and len({s.keys[0] for s in specs}) == 1 and len({s.keys for s in specs}) > 1:
                    # Nests with a common first key meet in its labels.
                    heads = [self.labels(replace(s, keys=s.keys[:1], context=(*s.context, *s.keys[1:], *filters))) for s in specs]
                    rows, tables = reduce(lambda a, b: a.unionByName(b), heads), heads
                for t in tables:
                    rows = rows.join(t.select("label").distinct(), "label", "left_semi")
        n = len(self.spec(parts[0]).keys) if op != "&" else 1
        one = lambda i: F.coalesce(F.col("label")[i]["label_str"], F.col("label")[i]["label_int"].cast("string"), F.col("label")[i]["label_double"].cast("string"), F.col("label")[i]["label_bool"].cast("string"))
        g = rows.groupBy("label").agg(F.countDistinct("item_id").alias("item_count"))
        return g.select(*(one(i).alias(f"key{i}") for i in range(n)), "item_count")

    def nest_arithmetic(self, x: Calc) -> DataFrame:
        """Arithmetic on groupings. Same keys: the left one's groups, what the others miss counts as 0. Else: by existing key pairs."""
        nests = list(dict.fromkeys(_nests(x)))
        specs = [self.spec(n) for n in nests]
        if any(s.value is None or isinstance(s.value, (Compare, Set)) for s in specs):
            raise QueryError("arithmetic on groupings needs their values")
        keys = _unique(k for s in specs for k in s.keys)
        same = len({s.keys for s in specs}) == 1
        tables = [self.table(s) for s in specs]
        if same:
            names = tables[0][1]
            base = tables[0][0].withColumnRenamed("nvalue", "__v0")
            for i, (t, _) in enumerate(tables[1:], 1):
                base = base.join(t.select(*names, F.col("nvalue").alias(f"__v{i}")), names, "left")
        else:
            base, names = self.table(Spec(keys))
            for i, (s, (t, own)) in enumerate(zip(specs, tables, strict=True)):
                at = [names[keys.index(k)] for k in s.keys]
                t = t.select(*(F.col(o).alias(a) for o, a in zip(own, at, strict=True)), F.col("nvalue").alias(f"__v{i}"))
                base = base.join(t, at, "left")

        def value(y):
            if isinstance(y, Nest):
                i = nests.index(y)
                return (F.col("__v0") if i == 0 and same else F.coalesce(F.col(f"__v{i}"), F.lit(0.0))), "double"
            if isinstance(y, Calc):
                (a, ak), (b, bk) = value(y.left), value(y.right)
                return _arithmetic(y.op, a, ak, b, bk)
            return self._value(y, lambda a: (_ for _ in ()).throw(QueryError("a single value inside arithmetic on groupings")))

        return base.select(*names, value(x)[0].cast("double").alias("nvalue"), "item_count")

    def group_filter(self, s: Spec, test, space: Space) -> Column:
        """The items of the groups that pass; several comparisons over the same keys share one aggregation."""
        inner = Space(self)
        tests = flat(test, "&") if isinstance(test, Set) else [test]
        sides = [(t.first, t.rest[0][0], t.rest[0][1]) for t in tests]
        nests = [n for a, _, b in sides for n in (*_nests(a), *_nests(b))]
        contexts = {self.spec(n).context for n in nests}
        if len(contexts) > 1:
            return self.across(*sides[0], space)
        context = (*s.context, *(next(iter(contexts)) if contexts else ()))
        cond, names = self.keyed(s.keys, context, inner)
        aggs, terms, rows = [], {}, inner

        def term(a):
            if a not in terms:
                c, kind, hit = self.aggregate(a, rows, True)
                terms[a] = F.col(f"__a{len(terms)}"), kind, hit
                aggs.append(c.alias(f"__a{len(terms) - 1}"))
            return terms[a]

        def value(y):
            if isinstance(y, Nest):
                v = self.spec(y).value
                return self._value(v if v is not None else Agg("max", self.spec(y).keys[-1]), term)
            if isinstance(y, Calc):
                (a, ak), (b, bk) = value(y.left), value(y.right)
                return _arithmetic(y.op, a, ak, b, bk)
            return self._value(y, term)

        verdicts = []
        for a, op, b in sides:
            (u, uk), (v, vk) = value(a), value(b)
            if ("string" in (uk, vk)) and uk != vk:
                raise QueryError("a comparison mixes text and numbers")
            verdicts.append(compare(u, op, v))
        verdict = reduce(lambda a, b: a & b, verdicts)
        frame = inner.frame.where(cond)
        passed = frame.groupBy(*names).agg(*aggs or [F.count(F.lit(1)).alias("__c")]).where(verdict).select(*names)
        if self.wide(s.keys):
            # Keys that the item table holds: the verdict goes back by them.
            inside = reduce(lambda a, b: a & b, [self.items(c, space) for c in context], F.lit(True))
            return inside & space.verdict([self.number(k, space)[0] for k in s.keys], passed)
        return space.flag(frame.select("item_id", *names).join(passed, names, "left_semi"))

    def wide(self, keys: tuple) -> bool:
        """Whether the item table has one value of each key for each item."""
        return all(not isinstance(k, (Tag, Pattern)) or self.catalog.get(k.type).column for k in keys)

    def across(self, a, op: str, b, space: Space) -> Column:
        """Groupings with different keys compare on the items that they share."""
        nests = list(dict.fromkeys((*_nests(a), *_nests(b))))
        specs = [self.spec(n) for n in nests]
        per, columns = None, None
        if all(s.value is not None and s.keys and self.wide(s.keys) for s in specs):
            columns = []
            for s in specs:
                g, names = self.table(s)
                inside = reduce(lambda u, v: u & v, [self.items(c, space) for c in s.context], F.lit(True))
                columns.append(F.when(inside, space.lookup([self.number(k, space)[0] for k in s.keys], g.select(*names, "nvalue"))))
        for i, s in enumerate(specs if columns is None else ()):
            if s.value is None:
                raise QueryError("groupings with different keys need values to compare")
            g, names = self.table(s)
            inner = Space(self)
            cond, _ = self.keyed(s.keys, s.context, inner)
            rows = inner.frame.where(cond).select("item_id", *names).join(g.select(*names, F.col("nvalue").alias(f"__v{i}")), names).select("item_id", f"__v{i}")
            per = rows if per is None else per.join(rows, "item_id")

        def value(y):
            if isinstance(y, Nest):
                return (columns[nests.index(y)] if columns else F.col(f"__v{nests.index(y)}")), "double"
            if isinstance(y, Calc):
                (u, uk), (v, vk) = value(y.left), value(y.right)
                return _arithmetic(y.op, u, uk, v, vk)
            return self._value(y, None)

        if columns:
            return compare(value(a)[0], op, value(b)[0])
        return space.flag(per.where(compare(value(a)[0], op, value(b)[0])))

    # --- Scalars -----------------------------------------------------------------------------------------------------

    def scalar(self, x) -> tuple[DataFrame, str]:
        """A one-row table with the column value, and the value's type name."""
        if isinstance(x, Agg):
            if isinstance(x.body, (Nest, Calc)) and _nests(x.body) or isinstance(x.body, Agg) and isinstance(x.body.body, Nest):
                return self.over_groups(x)
            if isinstance(x.body, Tag) and x.body.type == "type" and x.fn == "count":
                return self.type_projection().agg(F.count(F.lit(1)).alias("value")), "integer"
            if self.is_definition(x.body) and x.fn == "count":
                return self.definitions(x.body).agg(F.count(F.lit(1)).alias("value")), "integer"
            space = Space(self)
            c, kind, _ = self.aggregate(x, space, False)
            df = space.frame.agg(c.alias("value"))
            return df, "numeric" if kind == "numeric" else kind
        if isinstance(x, Lit):
            c, kind = self._value(x, None)
            return self.catalog.items.sparkSession.range(1).select(c.alias("value")), kind
        if isinstance(x, Calc):
            (a, ak), (b, bk) = self.scalar(x.left), self.scalar(x.right)
            both = a.select(F.col("value").alias("a")).crossJoin(F.broadcast(b.select(F.col("value").alias("b"))))
            c, kind = _arithmetic(x.op, F.col("a"), ak, F.col("b"), bk)
            return both.select(c.alias("value")), kind
        raise QueryError(f"no single value: {type(x).__name__}")

    def over_groups(self, x: Agg) -> tuple[DataFrame, str]:
        """An aggregate of group values; count gives the number of groups."""
        body = x.body
        if isinstance(body, Agg):
            inner, kind = self.over_groups(body) if _nests(body.body) else self.scalar(body)
            return inner, kind
        if isinstance(body, Calc):
            g = self.nest_arithmetic(body)
        else:
            s = self.spec(body)
            if isinstance(s.value, Compare):
                a, (op, b) = s.value.first, s.value.rest[0]
                side = a if not isinstance(a, Lit) else b
                g, names = self.table(replace(s, value=side))
                lit = b if side is a else a
                if not isinstance(lit, Lit):
                    other, _ = self.table(replace(s, value=lit))
                    g = g.join(other.select(*names, F.col("nvalue").alias("__r")), names).where(compare(F.col("nvalue"), op, F.col("__r")))
                else:
                    g = g.where(compare(F.col("nvalue"), op if side is a else TURN[op], self._value(lit, None)[0]))
            else:
                g, _ = self.table(s)
        if x.fn == "count":
            return g.agg(F.count(F.lit(1)).alias("value")), "integer"
        return g.agg(getattr(F, x.fn)("nvalue").alias("value")), "double"

    def boolean(self, x: Compare) -> DataFrame:
        """A one-row table: true, false or null."""
        a, (op, b) = x.first, x.rest[0]
        if not (self.is_scalar(a) and self.is_scalar(b)):
            raise QueryError("a scalar comparison needs single values on both sides")
        (u, uk), (v, vk) = self.scalar(a), self.scalar(b)
        if ("string" in (uk, vk)) and uk != vk and "numeric" not in (uk, vk):
            raise QueryError("a comparison mixes text and numbers")
        both = u.select(F.col("value").alias("a")).crossJoin(F.broadcast(v.select(F.col("value").alias("b"))))
        return both.select(compare(F.col("a"), op, F.col("b")).alias("value"), F.lit("boolean").alias("bitical_type"))

    # --- Definition items --------------------------------------------------------------------------------------------

    def is_definition(self, x) -> bool:
        if isinstance(x, Set) and x.op == "|":
            return self.is_definition(x.left) or self.is_definition(x.right)
        return isinstance(x, Typed) and x.type in ("type", "tag")

    def definitions(self, x) -> DataFrame:
        """Types or tags as items: stored ones, registered ones and those in use; stored ones win. Others of an or are added."""
        if isinstance(x, Set):
            a, b = ((self.definitions(y) if self.is_definition(y) else self.as_definitions(y)) for y in (x.left, x.right))
            return a.unionByName(b).distinct()
        spark, c = self.catalog.items.sparkSession, self.catalog
        regex = L.glob_regex(x.label.text)
        kind = x.type
        schema = "item_id long, name string, item_kind string, rank long, origin string"
        known = spark.createDataFrame([(None, d.name, "type", d.rank, "builtin") for d in c.defs.values()] if kind == "type" else [], schema)
        if c.tags is not None:
            text = F.coalesce("label_str", F.col("label_int").cast("string"), F.col("label_double").cast("string"), F.col("label_bool").cast("string"))
            name = F.col("type") if kind == "type" else F.concat_ws(":", "type", text)
            used = c.tags.select(F.lit(None).cast("long").alias("item_id"), name.alias("name"), F.lit(kind).alias("item_kind"), F.lit(0).cast("long").alias("rank"), F.lit("user").alias("origin")).distinct()
            known = known.unionByName(used.join(known.select("name"), "name", "left_anti"))
        if not L.is_pattern(x.label.text):  # an exact name is there even if nobody uses it
            one = spark.createDataFrame([(None, L.plain(x.label.text), kind, 0, "user")], schema)
            known = known.unionByName(one.join(known.select("name"), "name", "left_anti"))
        if c.definitions is not None:
            from ..functions.ids import origin_of

            stored = c.definitions.where(F.col("item_kind") == kind).select("item_id", "name", "item_kind", "rank", origin_of(F.col("item_id")).alias("origin"))
            known = stored.unionByName(known.join(stored.select("name"), "name", "left_anti"))
        return known.where(F.col("name").rlike(regex))

    def as_definitions(self, x) -> DataFrame:
        from ..functions.ids import origin_of

        df = self.run(x).df
        return df.select("item_id", F.lit(None).cast("string").alias("name"), "item_kind", "rank", origin_of(F.col("item_id")).alias("origin"))


# --- Trees -----------------------------------------------------------------------------------------------------------


def flat(x, op: str) -> list:
    """The operands of a run of one operator (of a difference: what it is taken from, and what is taken)."""
    if isinstance(x, Set) and x.op == op:
        return [*flat(x.left, op), *(flat(x.right, op) if op != "-" else [x.right])]
    return [x]


def _balanced(op: str, terms: list):
    """Many operands of one operator as a tree of little depth."""
    while len(terms) > 1:
        terms = [Set(op, *terms[k : k + 2]) if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)]
    return terms[0]


def _leaves(x) -> list:
    return [*_leaves(x.left), *_leaves(x.right)] if isinstance(x, Calc) else [x]


def _aggs(x) -> list:
    if isinstance(x, Agg):
        return [x]
    if isinstance(x, (Calc, Set, Nest)):
        return [*_aggs(x.left), *_aggs(x.right)]
    if isinstance(x, Compare):
        return [*_aggs(x.first), *(y for _, r in x.rest for y in _aggs(r))]
    return []


def _nests(x) -> list:
    if isinstance(x, Nest):
        return [x]
    return [*_nests(x.left), *_nests(x.right)] if isinstance(x, Calc) else []


def _unique(keys) -> tuple:
    return tuple(dict.fromkeys(keys))


def _grouped(c: Column, kind: str, p: Pattern) -> Column:
    if kind not in ("string", "any"):
        raise QueryError(f"{p.type}: only texts can be grouped by a pattern")
    return F.nullif(F.regexp_extract(c, L.group_regex(p.pattern), 1), F.lit(""))


def _text(c: Column, kind) -> Column:
    return c.cast("string")


def _arithmetic(op: str, a: Column, ak: str, b: Column, bk: str) -> tuple[Column, str]:
    if "string" in (ak, bk):
        if ak != bk:
            raise QueryError("arithmetic mixes text and numbers")
        if op not in "+*":
            raise QueryError(f"{op} has no meaning for texts")
        return (F.concat(a, F.lit(", "), b) if op == "+" else F.concat(a, b)), "string"
    a, b = numeric(a, ak), numeric(b, bk)
    return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "%": F.try_mod(a, b)}[op], "double"
