"""A read-only Cypher subset compiled to DataFrame plans.

Text becomes tokens, tokens a tree of ``Node`` tuples, the tree a chain of equi-joins over the graph's tables followed by a filter,
a projection or an aggregation, and sort, distinct, skip and limit. Catalyst does the optimising: the WHERE conjuncts sink
below the joins, so ``n.id = 'x'`` becomes a pushed filter of the scan.

Logic is two-valued: AND, OR and NOT take anything but true for false. Equality is strict and null equals null; ordering of
different types is null. Ascending order puts nulls last, descending is its exact reverse. Unlike a tree-walking
interpreter, unknown variables are refused before anything runs, and division by zero gives null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.errors import MAX_QUERY_CHARS, EngineError, invalid, unsupported
from engram.operators.graph import Graph

MAX_ROWS = 1000
# fixed values: words of the language that are refused by name
REFUSED = "CREATE SET DELETE MERGE REMOVE WITH UNWIND CALL OPTIONAL DETACH FOREACH UNION".split()
_AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}
_LEX = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")"""
    r"""|(?P<quoted>`[^`]+`)|(?P<word>[^\W\d]\w*)|(?P<mark><-|->|<>|<=|>=|=~|[-+*/%=<>()\[\]{},.:|])""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Token(NamedTuple):
    kind: str
    text: str
    raw: str


class Node(NamedTuple):
    """A node of the expression tree: an operation and its operands."""

    op: str
    args: tuple


@dataclass
class NodePattern:
    var: str | None = None
    labels: list[str] = field(default_factory=list)
    props: dict[str, Any] = field(default_factory=dict)


@dataclass
class EdgePattern:
    var: str | None = None
    types: list[str] = field(default_factory=list)
    props: dict[str, Any] = field(default_factory=dict)
    direction: str = "both"


@dataclass
class Query:
    patterns: list[tuple[list[NodePattern], list[EdgePattern]]]
    where: Node | None
    items: list[tuple[Node, str]] | None  # None: RETURN *
    distinct: bool
    order: list[tuple[Node, bool]]
    skip: int
    limit: int | None


def lex(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise invalid(f"unexpected character {source[at]!r} at {at}")
        at, kind, text = m.end(), m.lastgroup, m.group()
        if kind == "str":
            out.append(Token("str", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1], flags=re.S), text))
        elif kind == "quoted":
            out.append(Token("word", text[1:-1], text[1:-1]))
        elif kind != "skip":
            out.append(Token(kind, text, text))
    return out


class Parser:
    """Precedence climbing over the tokens."""

    LEVELS = [{"OR"}, {"AND"}, {"NOT"}, {"=", "<>", "<", "<=", ">", ">=", "CONTAINS", "STARTS", "ENDS", "IN", "IS", "=~"}, {"+", "-"}, {"*", "/", "%"}]

    def __init__(self, source: str):
        self.tokens, self.at = lex(source), 0

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else Token("end", "", "")

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else Token("end", "", "")

    def keyword(self, *words: str) -> bool:
        """Whether the next tokens are these words; takes them if so."""
        if all(self.peek(i).kind == "word" and self.peek(i).text.upper() == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def mark(self, text: str) -> bool:
        if self.peek().kind == "mark" and self.peek().text == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.mark(text):
            raise invalid(f"expected {text}, found {self.peek().raw or 'the end'}")

    def name(self, what: str) -> str:
        if self.peek().kind != "word":
            raise invalid(f"expected {what}, found {self.peek().raw or 'the end'}")
        return self.take().text

    def query(self) -> Query:
        patterns: list = []
        for count in range(3):
            self.refuse()
            if not self.keyword("MATCH"):
                if not count:
                    raise invalid("a query begins with MATCH")
                break
            if count == 2:
                raise unsupported("more than two MATCH clauses")
            patterns.append(self.pattern())
            while self.mark(","):
                patterns.append(self.pattern())
        where = self.expression() if self.keyword("WHERE") else None
        self.refuse()
        if not self.keyword("RETURN"):
            raise invalid("expected RETURN")
        distinct = self.keyword("DISTINCT")
        items: list | None = None
        if not self.mark("*"):
            items = [self.item()]
            while self.mark(","):
                items.append(self.item())
        order = []
        if self.keyword("ORDER", "BY"):
            while True:
                e = self.expression()
                down = self.keyword("DESC") or self.keyword("DESCENDING")
                if not down:
                    self.keyword("ASC") or self.keyword("ASCENDING")
                order.append((e, down))
                if not self.mark(","):
                    break
        skip = self.integer() if self.keyword("SKIP") else 0
        limit = self.integer() if self.keyword("LIMIT") else None
        self.refuse()
        if self.peek().kind != "end":
            raise invalid(f"unexpected {self.peek().raw}")
        return Query(patterns, where, items, distinct, order, skip, limit)

    def refuse(self) -> None:
        if self.peek().kind == "word" and self.peek().text.upper() in REFUSED:
            raise unsupported(f"{self.peek().text.upper()} is not supported")

    def integer(self) -> int:
        if self.peek().kind != "num":
            raise invalid("expected an integer")
        return int(float(self.take().text))

    def item(self) -> tuple[Node, str]:
        start = self.at
        e = self.expression()
        end = self.at
        if self.keyword("AS"):
            return e, self.name("an alias")
        return e, "".join(f"'{t.text}'" if t.kind == "str" else t.raw for t in self.tokens[start:end])

    def pattern(self):
        nodes, edges = [self.node()], []
        while self.peek().kind == "mark" and self.peek().text in ("-", "<-"):
            edges.append(self.edge())
            nodes.append(self.node())
        return nodes, edges

    def node(self) -> NodePattern:
        self.need("(")
        n = NodePattern()
        if self.peek().kind == "word":
            n.var = self.take().text
        while self.mark(":"):
            n.labels.append(self.name("a label"))
        n.props = self.properties()
        self.need(")")
        return n

    def edge(self) -> EdgePattern:
        e, into = EdgePattern(), self.mark("<-")
        if not into:
            self.need("-")
        if self.mark("["):
            if self.peek().kind == "word":
                e.var = self.take().text
            if self.mark(":"):
                e.types.append(self.name("a type"))
                while self.mark("|"):
                    self.mark(":")
                    e.types.append(self.name("a type"))
            if self.mark("*"):
                raise unsupported("variable-length paths are not supported; use k_hop")
            e.props = self.properties()
            self.need("]")
        if self.mark("->"):
            if into:
                raise unsupported("an arrow with two heads is not supported")
            e.direction = "out"
        else:
            self.need("-")
            e.direction = "in" if into else "both"
        return e

    def properties(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self.mark("{"):
            while not self.mark("}"):
                key = self.name("a property")
                self.need(":")
                e = self.expression()
                if e.op == "neg" and e.args[0].op == "lit":
                    e = Node("lit", (-e.args[0].args[0],))
                if e.op != "lit":
                    raise unsupported("an inline property value must be a literal")
                out[key] = e.args[0]
                self.mark(",")
        return out

    def expression(self, level: int = 0) -> Node:
        if level == len(self.LEVELS):
            return self.unary()
        if level == 2:
            return Node("not", (self.expression(2),)) if self.keyword("NOT") else self.expression(3)
        left = self.expression(level + 1)
        while True:
            t = self.peek()
            word = t.text.upper() if t.kind == "word" else t.text if t.kind == "mark" else ""
            if word not in self.LEVELS[level]:
                return left
            self.take()
            if word == "=~":
                raise unsupported("regular expressions are not supported")
            if word == "IS":
                negated = self.keyword("NOT")
                if not self.keyword("NULL"):
                    raise invalid("expected NULL")
                left = Node("isnull", (left,))
                left = Node("not", (left,)) if negated else left
                continue
            if word in ("STARTS", "ENDS") and not self.keyword("WITH"):
                raise invalid("expected WITH")
            left = Node(word.lower(), (left, self.expression(level + 1)))
            if level == 3 and self.peek().text in ("=", "<>", "<", "<=", ">", ">="):
                raise invalid("comparisons can't be chained")

    def unary(self) -> Node:
        if self.mark("-"):
            return Node("neg", (self.unary(),))
        e = self.atom()
        while self.mark("."):
            e = Node("prop", (e, self.name("a property")))
        return e

    def atom(self) -> Node:
        if self.mark("("):
            e = self.expression()
            self.need(")")
            return e
        if self.mark("["):
            items = []
            while not self.mark("]"):
                items.append(self.expression())
                self.mark(",")
            return Node("list", tuple(items))
        t = self.take()
        if t.kind == "num":
            return Node("lit", (float(t.text) if re.search(r"[.eE]", t.text) else int(t.text),))
        if t.kind == "str":
            return Node("lit", (t.text,))
        if t.kind != "word":
            raise invalid(f"unexpected {t.raw or 'end'}")
        constant = {"TRUE": True, "FALSE": False, "NULL": None}
        if t.text.upper() in constant:
            return Node("lit", (constant[t.text.upper()],))
        if not self.mark("("):
            return Node("var", (t.text,))
        name, args = t.text.lower(), []
        if self.mark("*"):
            if name != "count":
                raise invalid("only count takes *")
            self.need(")")
            return Node("call", ("count", Node("star", ())))
        if self.keyword("DISTINCT"):
            raise unsupported("aggregates of DISTINCT values are not supported")
        while not self.mark(")"):
            args.append(self.expression())
            self.mark(",")
        return Node("call", (name, *args))


def parse(source: str) -> Query:
    if not isinstance(source, str) or len(source) > MAX_QUERY_CHARS:
        raise invalid("a query is a string of bounded length")
    return Parser(source).query()


def has_aggregate(e: Node) -> bool:
    return (e.op == "call" and e.args[0] in _AGGREGATES) or any(has_aggregate(a) for a in e.args if isinstance(a, Node))


def _kind(t: T.DataType) -> str:
    for kind, types in (("num", T.NumericType), ("bool", T.BooleanType), ("str", (T.StringType, T.TimestampType, T.DateType)), ("list", T.ArrayType), ("null", T.NullType)):
        if isinstance(t, types):
            return kind
    return "edge" if isinstance(t, T.StructType) and "src" in t.names else "node" if isinstance(t, T.StructType) and "labels" in t.names else "map"


class Typed(NamedTuple):
    column: Column
    dtype: T.DataType

    @property
    def kind(self) -> str:
        return _kind(self.dtype)


_NULL = Typed(F.lit, T.NullType())


class Compiler:
    """Expressions over bound variables, which are struct columns named after them.

    ``weight`` is a column that tells for how many equal rows a row stands; aggregates count it so often.
    """

    def __init__(self, variables: dict[str, T.StructType], weight: Column | None = None):
        self.variables = variables
        self.weight = weight

    def truth(self, e: Node) -> Column:
        t = self.compile(e)
        return F.coalesce(t.column, F.lit(False)) if t.kind == "bool" else F.lit(False)

    def compile(self, e: Node) -> Typed:
        return getattr(self, f"_{e.op}", self._binary)(e)

    def _lit(self, e: Node) -> Typed:
        v = e.args[0]
        dtype = T.NullType() if v is None else T.BooleanType() if isinstance(v, bool) else T.StringType() if isinstance(v, str) else T.LongType() if isinstance(v, int) else T.DoubleType()
        return Typed(F.lit(v) if v is None else F.lit(v).cast(dtype), dtype)

    def _list(self, e: Node) -> Typed:
        items = [self.compile(a) for a in e.args]
        if not items:
            return Typed(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
        inner = next((i.dtype for i in items if i.kind != "null"), T.StringType())
        if any(i.kind == "num" and isinstance(i.dtype, T.DoubleType) for i in items):
            inner = T.DoubleType()
        if len({i.kind for i in items if i.kind != "null"}) > 1:
            raise unsupported("a list of values of different types")
        return Typed(F.array(*[i.column.cast(inner) for i in items]), T.ArrayType(inner))

    def _var(self, e: Node) -> Typed:
        name = e.args[0]
        if name not in self.variables:
            raise invalid(f"unknown variable {name}")
        return Typed(F.col(f"`{name}`"), self.variables[name])

    def _prop(self, e: Node) -> Typed:
        base, key = self.compile(e.args[0]), e.args[1]
        if not isinstance(base.dtype, T.StructType):
            return Typed(F.lit(None), T.NullType())
        props = base.dtype["props"].dataType if "props" in base.dtype.names else T.StructType()
        own = isinstance(props, T.StructType) and key in props.names
        pseudo = key in ("id", "confidence", "type") and key in base.dtype.names
        if own and pseudo:
            return Typed(F.coalesce(base.column[f"props"][key], base.column[key]), props[key].dataType)
        if own:
            return Typed(base.column["props"][key], props[key].dataType)
        return Typed(base.column[key], base.dtype[key].dataType) if pseudo else Typed(F.lit(None), T.NullType())

    def _not(self, e: Node) -> Typed:
        return Typed(~self.truth(e.args[0]), T.BooleanType())

    def _isnull(self, e: Node) -> Typed:
        return Typed(self.compile(e.args[0]).column.isNull(), T.BooleanType())

    def _neg(self, e: Node) -> Typed:
        a = self.compile(e.args[0])
        return Typed(-a.column, a.dtype) if a.kind == "num" else Typed(F.lit(None).cast("double"), T.DoubleType())

    def _binary(self, e: Node) -> Typed:
        op = e.op
        if op in ("and", "or"):
            a, b = self.truth(e.args[0]), self.truth(e.args[1])
            return Typed(a & b if op == "and" else a | b, T.BooleanType())
        a, b = (self.compile(x) for x in e.args)
        both = {a.kind, b.kind}
        never = Typed(F.lit(None).cast("boolean"), T.BooleanType())
        if op in ("=", "<>"):
            same = a.column.eqNullSafe(b.column) if len(both) == 1 or "null" in both else F.lit(False)
            return Typed(same if op == "=" else ~same, T.BooleanType())
        if op in ("<", "<=", ">", ">="):
            if len(both) > 1 or not both <= {"num", "str", "bool"}:
                return never
            test = {"<": a.column < b.column, "<=": a.column <= b.column, ">": a.column > b.column, ">=": a.column >= b.column}[op]
            return Typed(test, T.BooleanType())
        if op in ("contains", "starts", "ends"):
            if both != {"str"}:
                return never
            test = {"contains": a.column.contains(b.column), "starts": a.column.startswith(b.column), "ends": a.column.endswith(b.column)}[op]
            return Typed(test, T.BooleanType())
        if op == "in":
            if b.kind != "list" or (a.kind not in ("null", _kind(b.dtype.elementType))):
                return Typed(F.lit(False), T.BooleanType())
            return Typed(F.exists(b.column, lambda x: x.eqNullSafe(a.column)), T.BooleanType())
        if op == "+" and "list" in both:
            items = [x.column if x.kind == "list" else F.array(x.column) for x in (a, b)]
            return Typed(F.concat(*items), a.dtype if a.kind == "list" else b.dtype)
        if op == "+" and "str" in both and both <= {"str", "num", "bool"}:
            return Typed(F.concat(a.column.cast("string"), b.column.cast("string")), T.StringType())
        if both != {"num"}:
            return Typed(F.lit(None).cast("double"), T.DoubleType())
        if op == "/":
            return Typed(F.try_divide(a.column.cast("double"), b.column.cast("double")), T.DoubleType())
        whole = isinstance(a.dtype, T.IntegralType) and isinstance(b.dtype, T.IntegralType)
        dtype = T.LongType() if whole else T.DoubleType()
        x, y = a.column.cast(dtype), b.column.cast(dtype)
        return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: F.try_mod(x, y)}[op](), dtype)

    def _call(self, e: Node) -> Typed:
        name, *args = e.args
        if name in _AGGREGATES:
            return self.aggregate(name, args)
        a = [self.compile(x) for x in args]
        if not a:
            raise invalid(f"{name} needs an argument")
        x, dtype, kind = a[0].column, a[0].dtype, a[0].kind
        string, none = T.StringType(), lambda t: Typed(F.lit(None).cast(t), t)
        if name == "id":
            return Typed(x["id"], string) if kind in ("node", "edge") else none(string)
        if name == "labels":
            return Typed(x["labels"] if kind == "node" else F.array().cast("array<string>"), T.ArrayType(string))
        if name == "type":
            return Typed(x["type"], string) if kind == "edge" else none(string)
        if name in ("tolower", "toupper"):
            return Typed(F.lower(x) if name == "tolower" else F.upper(x), string) if kind == "str" else none(string)
        if name == "tostring":
            return Typed(x.cast("string"), string)
        if name == "tointeger":
            return Typed(x.cast("double").cast("long") if kind == "num" else x.try_cast("double").cast("long"), T.LongType()) if kind in ("num", "str") else none(T.LongType())
        if name == "tofloat":
            return Typed(x.cast("double") if kind == "num" else x.try_cast("double"), T.DoubleType()) if kind in ("num", "str") else none(T.DoubleType())
        if name == "size":
            return Typed((F.size(x) if kind == "list" else F.length(x)).cast("long"), T.LongType()) if kind in ("list", "str") else none(T.LongType())
        if name == "coalesce":
            inner = next((t.dtype for t in a if t.kind != "null"), T.NullType())
            return Typed(F.coalesce(*[t.column for t in a]), inner)
        if name == "keys":
            names = dtype["props"].dataType.names if kind in ("node", "edge") else []
            held = F.array(*[F.when(x["props"][n].isNotNull(), F.lit(n)) for n in names]) if names else F.array().cast("array<string>")
            return Typed(F.filter(held, lambda k: k.isNotNull()), T.ArrayType(string))
        if name == "properties":
            return Typed(x["props"], dtype["props"].dataType) if kind in ("node", "edge") else none(string)
        if name == "abs":
            return Typed(F.abs(x), dtype) if kind == "num" else none(T.DoubleType())
        if name == "round":
            return Typed(F.floor(x + F.lit(0.5)).cast("double"), T.DoubleType()) if kind == "num" else none(T.DoubleType())
        raise unsupported(f"unknown function {name}")

    def _weighted(self, name: str, x: Column, dtype: T.DataType) -> Column:
        """The sum, mean or count of ``x`` over rows that stand for several."""
        held = F.when(x.isNotNull(), self.weight)
        if name == "count":
            return F.coalesce(F.sum(held), F.lit(0).cast("long"))
        wide = x.cast("long" if name == "sum" and isinstance(dtype, T.IntegralType) else "double")
        total = F.sum(wide * self.weight)
        return total if name == "sum" else total / F.sum(held)

    def aggregate(self, name: str, args: list[Node]) -> Typed:
        if name == "count":
            if self.weight is not None:
                return Typed(self._weighted("count", F.lit(1) if args and args[0].op == "star" else self.compile(args[0]).column, T.LongType()), T.LongType())
            if args and args[0].op == "star":
                return Typed(F.count(F.lit(1)), T.LongType())
            return Typed(F.count(self.compile(args[0]).column), T.LongType())
        a = self.compile(args[0])
        if name == "collect":
            return Typed(F.array_sort(F.collect_list(a.column)), T.ArrayType(a.dtype))
        if name == "sum":
            dtype = T.LongType() if isinstance(a.dtype, T.IntegralType) else T.DoubleType()
            total = F.sum(a.column) if self.weight is None else self._weighted("sum", a.column, a.dtype)
            return Typed(F.coalesce(total, F.lit(0).cast(dtype)), dtype)
        if name == "avg":
            return Typed(F.avg(a.column) if self.weight is None else self._weighted("avg", a.column, a.dtype), T.DoubleType())
        return Typed(F.min(a.column) if name == "min" else F.max(a.column), a.dtype)


def _check_aggregates(e: Node) -> None:
    """Arithmetic and functions of aggregates are fine; null tests, properties and lists around them aren't."""
    if e.op == "call" and e.args[0] in _AGGREGATES:
        return
    if has_aggregate(e) and e.op in ("isnull", "prop", "list", "not", "and", "or"):
        raise unsupported("this expression of an aggregate is not supported")
    for a in e.args:
        if isinstance(a, Node):
            _check_aggregates(a)


def _variables(e: Node) -> set[str]:
    own = {e.args[0]} if e.op == "var" else set()
    return own.union(*(_variables(a) for a in e.args if isinstance(a, Node)))


def _collects(e: Node) -> bool:
    return (e.op == "call" and e.args[0] == "collect") or any(_collects(a) for a in e.args if isinstance(a, Node))


def _groupable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_groupable(f.dataType) for f in t.fields)
    return _groupable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType))


_TURNED = {"out": "in", "in": "out", "both": "both"}
_WEIGHT = "_anonymous weight"


def _from_bound(patterns) -> list:
    """The same patterns, cut and turned so that each begins at a node that earlier ones bind, if it holds one."""
    out, known = [], set()
    for nodes, edges in patterns:
        at = next((i for i, n in enumerate(nodes) if n.var and n.var in known), 0)
        if at:
            turned = [replace(e, direction=_TURNED[e.direction]) for e in reversed(edges[:at])]
            out.append((nodes[at::-1], turned))
        if not at or edges[at:]:
            out.append((nodes[at:], edges[at:]))
        known |= {n.var for n in nodes if n.var}
    return out


class Plan:
    def __init__(self, graph: Graph):
        self.graph = graph
        self.node_type = graph.nodes.select(self._node_struct()).schema[0].dataType
        self.edge_type = graph.edges.select(self._edge_struct()).schema[0].dataType
        self.hidden = 0

    def _node_struct(self) -> Column:
        return F.struct("id", "labels", "props")

    def _edge_struct(self) -> Column:
        return F.struct("id", "src", "dst", "type", "confidence", *(["props"] if "props" in self.graph.edges.columns else []))

    def _matches(self, struct: str, dtype: T.StructType, props: dict[str, Any], fields: tuple[str, ...]) -> Column:
        c, test = Compiler({struct: dtype}), F.lit(True)
        for key, value in props.items():
            own = Node("prop", (Node("var", (struct,)), key))
            left = Typed(F.col(f"`{struct}`")[key], dtype[key].dataType) if key in fields else c.compile(own)
            right = c.compile(Node("lit", (value,)))
            same = left.column.eqNullSafe(right.column) if left.kind == right.kind or "null" in (left.kind, right.kind) else F.lit(False)
            test = test & same
        return test

    def name(self, given: str | None) -> str:
        self.hidden += 1
        return given or f"_anonymous{self.hidden}"

    def node_frame(self, p: NodePattern, var: str) -> DataFrame:
        df = self.graph.nodes.select(self._node_struct().alias(var))
        for label in p.labels:
            df = df.where(F.array_contains(F.col(f"`{var}`")["labels"], label))
        return df.where(self._matches(var, self.node_type, p.props, ("id",)))

    def edge_frame(self, p: EdgePattern, var: str) -> DataFrame:
        """The edges with the ends as they are met from left to right."""
        df = self.graph.edges.select(self._edge_struct().alias(var))
        if p.types:
            df = df.where(F.col(f"`{var}`")["type"].isin(p.types))
        df = df.where(self._matches(var, self.edge_type, p.props, ("confidence",)))
        e = F.col(f"`{var}`")
        out = df.select(e, e["src"].alias("_from"), e["dst"].alias("_to"))
        into = df.select(e, e["dst"].alias("_from"), e["src"].alias("_to"))
        if p.direction == "both":
            return out.unionByName(into.where("_from <> _to"))
        return out if p.direction == "out" else into

    def _fold(self, rows: DataFrame, bound: dict, alive: set[str]) -> DataFrame:
        """Rows that agree in the variables still asked for as one row with a weight, before a join multiplies them.

        An edge that is still asked for tells its rows apart, so nothing is gained behind one.
        """
        held = [v for v in bound if v in alive and v in rows.columns]
        gone = [v for v in bound if v not in alive and v in rows.columns]
        if not gone or any(bound[v] == self.edge_type or not _groupable(bound[v]) for v in held):
            return rows
        weight = (F.sum(_WEIGHT) if _WEIGHT in rows.columns else F.count(F.lit(1))).alias(_WEIGHT)
        return rows.groupBy(*(F.col(f"`{v}`") for v in held)).agg(weight) if held else rows.agg(weight).where(F.col(_WEIGHT) > 0)

    def match(self, patterns, asked: set[str] | None = None) -> tuple[DataFrame, dict[str, T.StructType], set[str]]:
        """Rows of all bound variables, their types, and the names given. With the set of the variables that are ``asked`` for
        afterwards, rows may come without the others, each with the number of rows that it stands for (``_WEIGHT``)."""
        rows: DataFrame | None = None
        bound: dict[str, T.StructType] = {}
        named: list[str] = []
        if asked is not None:
            patterns = _from_bound(patterns)
        for k, (nodes, edges) in enumerate(patterns):
            later = {x.var for ns, es in patterns[k + 1 :] for x in (*ns, *es) if x.var}
            compared = {e.var for _, es in patterns for e in es if e.var}  # named edges differ from each other
            part = nodes[0]
            var = self.name(part.var)
            if asked is not None and rows is not None and var not in bound:
                rows = self._fold(rows, bound, asked | later | compared | {x.var for x in (*nodes, *edges) if x.var})
            rows = self._bind(rows, bound, self.node_frame(part, var), var)
            here = var
            for i, (e, n) in enumerate(zip(edges, nodes[1:], strict=True)):
                if asked is not None:
                    rows = self._fold(rows, bound, asked | later | compared | {here} | {x.var for x in (*nodes[i + 1 :], *edges[i:]) if x.var})
                if e.var in bound:  # the same edge can't be bound twice
                    rows = rows.where(F.lit(False))
                edge_var, node_var = self.name(e.var if e.var not in bound else None), self.name(n.var)
                rows = rows.join(self.edge_frame(e, edge_var), F.col(f"`{here}`")["id"] == F.col("_from"))
                bound[edge_var] = self.edge_type
                if node_var in bound:
                    known = self.node_frame(n, "_again").select(F.col("_again")["id"].alias("_again_id"))
                    rows = rows.where(F.col(f"`{node_var}`")["id"] == F.col("_to")).join(known, F.col("_to") == F.col("_again_id"), "left_semi").drop("_from", "_to")
                else:
                    rows = rows.join(self.node_frame(n, node_var), F.col("_to") == F.col(f"`{node_var}`")["id"]).drop("_from", "_to")
                    bound[node_var] = self.node_type
                if e.var:
                    for other in named:
                        rows = rows.where(F.col(f"`{edge_var}`")["id"] != F.col(f"`{other}`")["id"])
                    named.append(edge_var)
                here = node_var
        return rows, bound, {v for v in bound if not v.startswith("_anonymous")}

    def _bind(self, rows: DataFrame | None, bound: dict, frame: DataFrame, var: str) -> DataFrame:
        if rows is None:
            bound[var] = self.node_type
            return frame
        if var in bound:
            return rows.join(frame.select(F.col(f"`{var}`")["id"].alias("_again_id")), F.col(f"`{var}`")["id"] == F.col("_again_id"), "left_semi")
        bound[var] = self.node_type
        return rows.crossJoin(frame)  # comma patterns without a shared variable are a product by definition

    def run(self, q: Query, max_rows: int = MAX_ROWS) -> DataFrame:
        told = [e for e, _ in q.items or ()]
        aggregated = any(has_aggregate(e) for e in told)
        asked = None
        if aggregated and not any(_collects(e) for e in told):
            asked = set().union(*(_variables(e) for e in (*told, *(e for e, _ in q.order), *([] if q.where is None else [q.where]))))
        rows, bound, shown = self.match(q.patterns, asked)
        compiler = Compiler({v: bound[v] for v in shown}, F.col(_WEIGHT) if _WEIGHT in rows.columns else None)
        if q.where is not None:
            rows = rows.where(compiler.truth(q.where))
        items = [(Node("var", (v,)), v) for v in bound if v in shown] if q.items is None else q.items
        aliases = [a for _, a in items]
        keys: list[Column] = []
        if aggregated:
            for e, _ in items:
                _check_aggregates(e)
            groups = [compiler.compile(e).column.alias(f"_k{i}") for i, (e, _) in enumerate(items) if not has_aggregate(e)]
            values = [compiler.compile(e).column.alias(f"_k{i}") for i, (e, _) in enumerate(items) if has_aggregate(e)]
            out = rows.groupBy(*groups).agg(*values) if groups else rows.agg(*values)
            for e, down in q.order:
                if e.op == "var" and e.args[0] in aliases:
                    keys.append(self._key(F.col(f"_k{aliases.index(e.args[0])}"), down))
                elif any(e == x for x, _ in items):
                    keys.append(self._key(F.col(f"_k{next(i for i, (x, _) in enumerate(items) if x == e)}"), down))
                else:
                    raise invalid("an aggregated query is ordered by what it returns")
            out = out.select(*[F.col(f"_k{i}") for i in range(len(items))])
        else:
            computed = [compiler.compile(e).column.alias(f"_k{i}") for i, (e, _) in enumerate(items)]
            sorts = []
            for j, (e, down) in enumerate(q.order):
                by_alias = e.op == "var" and e.args[0] in aliases
                column = compiler.compile(items[aliases.index(e.args[0])][0]).column if by_alias else compiler.compile(e).column
                sorts.append(column.alias(f"_s{j}"))
                keys.append(self._key(F.col(f"_s{j}"), down))
            out = rows.select(*computed, *sorts)
        visible = [f"_k{i}" for i in range(len(items))]
        if q.distinct:
            if keys:  # sorted before it is made distinct: the first of equal rows decides
                order = F.row_number().over(W.partitionBy(*visible).orderBy(*keys))
                out = out.withColumn("_first", order).where("_first = 1")
            else:
                out = out.distinct()
        ties = [F.col(c).asc_nulls_last() for c, t in out.select(*visible).dtypes if not t.startswith(("struct", "map"))]
        cut = min(q.limit if q.limit is not None else max_rows, max_rows)
        if keys or q.skip or q.limit is not None:
            out = out.orderBy(*keys, *ties)
        out = out.offset(q.skip).limit(cut) if q.skip else out.limit(cut)
        return out.select(*[F.col(f"_k{i}").alias(a) for i, a in enumerate(aliases)])

    @staticmethod
    def _key(column: Column, down: bool) -> Column:
        return column.desc_nulls_first() if down else column.asc_nulls_last()


def query(graph: Graph, source: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of a query; ties and unordered results come in order of the returned values."""
    return Plan(graph).run(parse(source), max_rows)


def elements(result: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The distinct nodes and the distinct edges among a result's returned elements."""
    found: dict[str, list[DataFrame]] = {"node": [], "edge": []}
    for f in result.schema.fields:
        if isinstance(f.dataType, T.StructType) and (kind := _kind(f.dataType)) in found:
            found[kind].append(result.select(F.col(f"`{f.name}`.*")).where(F.col("id").isNotNull()))
    union = lambda frames: reduce(DataFrame.unionByName, frames).dropDuplicates(["id"]) if frames else None
    return union(found["node"]), union(found["edge"])


__all__ = ["EngineError", "Plan", "elements", "parse", "query"]
