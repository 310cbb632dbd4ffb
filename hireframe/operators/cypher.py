"""Read-only graph patterns over node and edge DataFrames.

A query text is cut into tokens, parsed by an allow-list grammar (there is no rule for writing, CALL or a
second statement) and lowered clause by clause to DataFrame operations; Catalyst plans the joins. A row
holds one column for each variable: a struct for a node or edge, a value otherwise.

MATCH joins edges and nodes pattern by pattern, from a node that is bound already wherever a pattern has
one; no edge stands twice in one MATCH. Patterns without a common variable, or an equality in WHERE that
ties them, are refused unless the graph was opened with ``cross``. OPTIONAL MATCH is a left join of the
whole pattern with its WHERE; RETURN and WITH group by their items without aggregates; ORDER BY takes
null as the largest value. Property values are text: compared with a number they are read as one.
Parameters are bound as literals. An edge is told from others by all its columns, never by a hash.

A pattern of at most UNROLLED steps is unrolled into joins. Beyond that, and for an open number of steps,
the frontier is expanded round by round: a round joins the paths that the last one made with the edges,
keeps those that use no edge twice, and is written before the next; the rounds end when no path grows, as
every path ends when its edges are used up. One row a path, so a graph with many cycles has many. Where
the next projection cannot tell how often a row occurs (DISTINCT, or only DISTINCT, min and max
aggregates), a directed pattern from 0 or 1 steps on keeps pairs of ends alone, each once, so the rounds
grow with the pairs instead of the paths.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from .graph import sorted_map

TOKEN = re.compile(r"\s*(?:(//[^\n]*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+\.\d+|\d+)|(`[^`]+`|[^\W\d]\w*)|(\$\w+)|(<=|>=|<>|=~|\.\.|->|<-|[-+*/%=<>()\[\]{},.:|;]))", re.S)
CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNWIND", "ORDER", "SKIP", "LIMIT"}
AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}
#: Rows up to which a pattern that nothing ties to them may be joined with each.
FEW = 1000
#: Steps of a pattern of variable length that are unrolled into one plan, at most; longer ones go round by round.
UNROLLED = 3


class CypherError(ValueError):
    pass


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise CypherError(f"cannot read {source[at : at + 20]!r}")
        at = m.end()
        for kind, value in zip(("comment", "text", "number", "name", "parameter", "sign"), m.groups(), strict=True):
            if value is not None and kind != "comment":
                out.append((kind, value))
    return out


class Parser:
    """A cursor over tokens with the rules of the grammar."""

    def __init__(self, source: str):
        self.all, self.at = tokens(source), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.all[self.at + ahead] if self.at + ahead < len(self.all) else ("end", "")

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        kind, value = self.peek(ahead)
        return kind == "name" and value.upper() in words

    def is_sign(self, *signs: str, ahead: int = 0) -> bool:
        kind, value = self.peek(ahead)
        return kind == "sign" and value in signs

    def take(self) -> tuple[str, str]:
        got = self.peek()
        self.at += 1
        return got

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def sign(self, *signs: str) -> str | None:
        if self.is_sign(*signs):
            return self.take()[1]
        return None

    def need(self, sign: str) -> None:
        if not self.sign(sign):
            raise CypherError(f"expected {sign!r} before {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.take()
        if kind != "name":
            raise CypherError(f"expected a name, got {value!r}")
        return value.strip("`")

    # expressions, as nested tuples

    def expression(self):
        left = self.conjunction()
        while self.word("OR"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.word("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self):
        return ("not", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self):
        left = self.sum()
        while True:
            if op := self.sign("=", "<>", "<", ">", "<=", ">=", "=~"):
                left = ("compare", op, left, self.sum())
            elif self.word("IN"):
                left = ("in", left, self.sum())
            elif self.word("CONTAINS"):
                left = ("contains", left, self.sum())
            elif self.is_word("STARTS", "ENDS") and self.is_word("WITH", ahead=1):
                kind = self.take()[1].upper()
                self.take()
                left = ("starts" if kind == "STARTS" else "ends", left, self.sum())
            elif self.word("IS"):
                negated = self.word("NOT")
                if not self.word("NULL"):
                    raise CypherError("expected NULL")
                left = ("null", left, negated)
            else:
                return left

    def sum(self):
        left = self.product()
        while op := self.sign("+", "-"):
            left = ("math", op, left, self.product())
        return left

    def product(self):
        left = self.unary()
        while op := self.sign("*", "/", "%"):
            left = ("math", op, left, self.unary())
        return left

    def unary(self):
        if self.sign("-"):
            return ("math", "-", ("value", 0), self.unary())
        left = self.atom()
        while sign := self.sign(".", "["):
            if sign == ".":
                left = ("property", left, self.name())
            else:
                left = ("at", left, self.expression())
                self.need("]")
        return left

    def atom(self):
        kind, value = self.take()
        if kind == "text":
            return ("value", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "number":
            return ("value", float(value) if "." in value else int(value))
        if kind == "parameter":
            return ("parameter", value[1:])
        if kind == "sign" and value == "(":
            inner = self.expression()
            self.need(")")
            return inner
        if kind == "sign" and value == "[":
            if self.peek()[0] == "name" and self.is_word("IN", ahead=1):
                return self.comprehension()
            return ("list", self.several("]"))
        if kind == "sign" and value == "*":
            return ("star",)
        if kind == "name":
            if value.upper() in ("TRUE", "FALSE", "NULL"):
                return ("value", {"TRUE": True, "FALSE": False, "NULL": None}[value.upper()])
            if value.upper() == "CASE":
                return self.case()
            if self.sign("("):
                distinct = self.word("DISTINCT")
                return ("call", value.lower(), distinct, self.several(")"))
            return ("variable", value.strip("`"))
        raise CypherError(f"cannot read {value!r}")

    def comprehension(self):
        """[name IN list WHERE test | value]"""
        name = self.name()
        self.word("IN")
        source = self.expression()
        test = self.expression() if self.word("WHERE") else None
        made = self.expression() if self.sign("|") else None
        self.need("]")
        return ("each", name, source, test, made)

    def case(self):
        of = None if self.is_word("WHEN") else self.expression()
        branches = []
        while self.word("WHEN"):
            test = self.expression()
            if not self.word("THEN"):
                raise CypherError("expected THEN")
            branches.append((test if of is None else ("compare", "=", of, test), self.expression()))
        other = self.expression() if self.word("ELSE") else ("value", None)
        if not branches or not self.word("END"):
            raise CypherError("expected END of CASE")
        return ("case", branches, other)

    def several(self, end: str) -> list:
        out = []
        while not self.sign(end):
            out.append(self.expression())
            if not self.sign(",") and not self.is_sign(end):
                raise CypherError(f"expected {end!r}")
        return out

    # patterns

    def properties(self) -> dict:
        out = {}
        if self.sign("{"):
            while not self.sign("}"):
                key = self.name()
                self.need(":")
                out[key] = self.expression()
                self.sign(",")
        return out

    def node(self) -> dict:
        self.need("(")
        out = {"var": self.name() if self.peek()[0] == "name" else None, "labels": []}
        while self.sign(":"):
            out["labels"].append(self.name())
        out["properties"] = self.properties()
        self.need(")")
        return out

    def edge(self) -> dict:
        back = bool(self.sign("<-"))
        if not back and not self.sign("-"):
            raise CypherError("expected an edge")
        out = {"var": None, "types": [], "steps": None, "properties": {}}
        if self.sign("["):
            if self.peek()[0] == "name":
                out["var"] = self.name()
            if self.sign(":"):
                out["types"].append(self.name())
                while self.sign("|"):
                    self.sign(":")
                    out["types"].append(self.name())
            if self.sign("*"):
                low = self.whole()
                out["steps"] = (1 if low is None else low, self.whole()) if self.sign("..") else (1, None) if low is None else (low, low)
            out["properties"] = self.properties()
            self.need("]")
        if self.sign("->"):
            out["direction"] = "both" if back else "out"
        else:
            self.need("-")
            out["direction"] = "in" if back else "both"
        return out

    def whole(self) -> int | None:
        return int(self.take()[1]) if self.peek()[0] == "number" else None

    def pattern(self) -> tuple[str | None, list]:
        path = None
        if self.peek()[0] == "name" and self.is_sign("=", ahead=1):
            path = self.name()
            self.need("=")
        chain = [self.node()]
        while self.is_sign("-", "<-"):
            chain += [self.edge(), self.node()]
        return path, chain

    def items(self) -> list[tuple]:
        out = []
        while True:
            start = self.at
            e = self.expression()
            label = "".join(v for _, v in self.all[start : self.at])
            out.append((e, self.name() if self.word("AS") else label, e[0]))
            if not self.sign(","):
                return out

    def clauses(self) -> list[tuple]:
        out = []
        while self.peek()[0] != "end":
            if self.sign(";"):
                if self.peek()[0] != "end":
                    raise CypherError("one statement at a time")
                break
            if self.is_word("MATCH", "OPTIONAL"):
                optional = self.word("OPTIONAL")
                if not self.word("MATCH"):
                    raise CypherError("expected MATCH")
                patterns = [self.pattern()]
                while self.sign(","):
                    patterns.append(self.pattern())
                out.append(("match", patterns, self.expression() if self.word("WHERE") else None, optional))
            elif self.word("UNWIND"):
                e = self.expression()
                if not self.word("AS"):
                    raise CypherError("expected AS")
                out.append(("unwind", e, self.name()))
            elif self.is_word("WITH", "RETURN"):
                kind = self.take()[1].lower()
                distinct = self.word("DISTINCT")
                items = self.items()
                order, skip, limit = [], None, None
                if self.word("ORDER"):
                    self.word("BY")
                    while True:
                        e = self.expression()
                        order.append((e, self.word("DESC", "DESCENDING")))
                        self.word("ASC", "ASCENDING")
                        if not self.sign(","):
                            break
                if self.word("SKIP"):
                    skip = self.expression()
                if self.word("LIMIT"):
                    limit = self.expression()
                where = self.expression() if kind == "with" and self.word("WHERE") else None
                out.append(("project", kind, distinct, items, order, skip, limit, where))
            else:
                raise CypherError(f"only reading clauses are known, not {self.peek()[1]!r}")
        if not out or out[-1][:2] != ("project", "return"):
            raise CypherError("a query ends with RETURN")
        return out


class Graph:
    """Runs query texts on nodes (id, labels, properties) and edges (src, dst, type, properties).

    cross: whether patterns that nothing ties together may be joined, each row with each.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, cross: bool = False):
        self.nodes = nodes.select("id", "labels", "properties")
        self.edges = edges.select("src", "dst", "type", "properties")
        self.cross = cross

    def query(self, source: str, parameters: dict | None = None) -> DataFrame:
        return _Lowering(self, parameters or {}).run(Parser(source).clauses())


def variables(e) -> set[str]:
    """Variables that an expression names."""
    if isinstance(e, tuple):
        return {e[1]} if e[:1] == ("variable",) else set().union(*map(variables, e))
    return set().union(*map(variables, e)) if isinstance(e, list) else set()


def conjuncts(e) -> list:
    return [] if e is None else conjuncts(e[1]) + conjuncts(e[2]) if e[0] == "and" else [e]


def repeats_matter(clauses: list[tuple]) -> bool:
    """Whether the first projection of clauses can tell how often a row occurs."""
    for clause in clauses:
        if clause[0] == "project":
            _, _, distinct, items, *_ = clause
            found = [a for e, _, _ in items for a in aggregates(e)]
            return not (all(name in ("min", "max") or once for _, name, once, _ in found) if found else distinct)
    return True


def counts_ends(clauses: list[tuple]) -> bool:
    """Whether clauses begin with a MATCH of one walk, and the next projection groups its ends by their values and only counts rows."""
    if len(clauses) < 2 or clauses[0][0] != "match" or clauses[1][0] != "project":
        return False
    _, patterns, where, optional = clauses[0]
    _, _, _, items, order, *_ = clauses[1]
    if optional or len(patterns) != 1 or patterns[0][0] is not None or len(patterns[0][1]) != 3:
        return False
    start, edge, end = patterns[0][1]
    found = [a for e, _, _ in items for a in aggregates(e)]
    if not edge["steps"] or edge["var"] is not None or (edge["steps"][1] is not None and edge["steps"][1] <= UNROLLED) or not found or start["var"] is not None and start["var"] == end["var"]:
        return False
    gone = {start["var"]} - {None}
    asked = [variables(e) for e in conjuncts(where)]
    said = set().union(*(variables(e) for e, _, _ in items), *(variables(e) for e, _ in order))
    return all(a[1] == "count" and not a[2] and a[3] == [("star",)] for a in found) and not gone & said and ("star",) not in [e for e, _, _ in items] and all(a == gone or not a & gone for a in asked)


def aggregates(e) -> list[tuple]:
    """Aggregate calls within an expression."""
    if isinstance(e, tuple):
        return [e] if e[:1] == ("call",) and e[1] in AGGREGATES else [a for x in e for a in aggregates(x)]
    return [a for x in e for a in aggregates(x)] if isinstance(e, list) else []


def edge_identity(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c["src"].alias("src"), c["dst"].alias("dst"), c["type"].alias("type"), F.array_sort(F.map_entries(F.coalesce(c["properties"], F.create_map().cast("map<string,string>")))).alias("properties")))


EDGE_IDENTITY = "struct<src:string,dst:string,type:string,properties:array<struct<key:string,value:string>>>"
EDGE = "struct<src:string,dst:string,type:string,properties:map<string,string>>"
NODE = "struct<id:string,labels:array<string>,properties:map<string,string>>"


def identity(c: Column, kind: str | None) -> Column:
    """What a value can be compared and grouped by; maps cannot."""
    if kind == "node":
        return c["id"]
    if kind == "edge":
        return edge_identity(c)
    if kind == "nodes":
        return F.transform(c, lambda x: x["id"])
    if kind == "edges":
        return F.transform(c, edge_identity)
    if kind == "path":
        return F.when(c.isNotNull(), F.struct(identity(c["nodes"], "nodes").alias("nodes"), identity(c["relationships"], "edges").alias("relationships")))
    return c


def shown(c: Column, kind: str | None) -> Column:
    """A value for a result: nodes, edges and paths as JSON."""
    if kind in ("node", "edge"):
        parts = ("id", "labels") if kind == "node" else ("src", "dst", "type")
        return F.when(c.isNotNull(), F.to_json(F.struct(*[c[p].alias(p) for p in parts], sorted_map(c["properties"]).alias("properties"))))
    if kind in ("nodes", "edges"):
        return F.transform(c, lambda x: shown(x, kind[:-1]))
    if kind == "path":
        return F.when(c.isNotNull(), F.to_json(F.struct(shown(c["nodes"], "nodes").alias("nodes"), shown(c["relationships"], "edges").alias("relationships"))))
    return c


#: Functions of text, whose value is text, and of numbers, by their names in the language.
TEXT_CALLS = {"tolower": F.lower, "toupper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "left": F.left, "right": F.right, "tostring": lambda c: c.cast("string")}
PLAIN_CALLS = {"coalesce": F.coalesce, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "sign": F.signum, "exp": F.exp, "log": F.ln, "log10": F.log10, "keys": lambda c: F.map_keys(c["properties"]), "exists": lambda c: c.isNotNull()}


class _Lowering:
    def __init__(self, graph: Graph, parameters: dict):
        self.graph, self.parameters, self.fresh = graph, parameters, count()
        #: node, edge, nodes, edges or path of the variables that are no plain values
        self.kinds: dict[str, str] = {}
        #: variables of list comprehensions
        self.local: dict[str, Column] = {}
        self.types: dict[str, T.DataType] = {}
        self.few, self.once = True, False
        #: whether the coming MATCH is one walk whose paths are only counted by their ends; whether rows have a number of paths
        self.counted = self.weighted = False

    def run(self, clauses: list[tuple]) -> DataFrame:
        df: DataFrame | None = None
        for k, clause in enumerate(clauses):
            self.once = not repeats_matter(clauses[k + 1 :])
            self.counted = k == 0 and counts_ends(clauses)
            if df is not None:
                self.types = {f.name: f.dataType for f in df.schema}
            df = getattr(self, clause[0])(df, *clause[1:])
        return df

    # expressions

    def value(self, e, known: set[str]) -> Column:
        kind = e[0]
        if kind == "value":
            return F.lit(e[1])
        if kind == "parameter":
            if e[1] not in self.parameters:
                raise CypherError(f"parameter ${e[1]} is missing")
            v = self.parameters[e[1]]
            return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        if kind == "list":
            return F.array(*[self.value(x, known) for x in e[1]])
        if kind == "variable":
            if e[1] in self.local:
                return self.local[e[1]]
            if e[1] not in known:
                raise CypherError(f"{e[1]} is not defined")
            return F.col(f"`{e[1]}`")
        if kind == "at":
            at = self.value(e[2], known).cast("int")
            return F.get(self.value(e[1], known), F.when(at < 0, at + F.size(self.value(e[1], known))).otherwise(at))
        if kind == "each":
            return self.each(e, known)
        if kind == "case":
            out = self.value(e[2], known)
            for test, then in reversed(e[1]):
                out = F.when(self.value(test, known), self.plain(then, known)).otherwise(out)
            return out
        if kind == "property":
            return self.value(e[1], known)["properties"][e[2]]
        if kind in ("and", "or"):
            a, b = self.value(e[1], known), self.value(e[2], known)
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.value(e[1], known)
        if kind == "null":
            c = self.value(e[1], known)
            return c.isNotNull() if e[2] else c.isNull()
        if kind == "in":
            return F.array_contains(self.value(e[2], known), self.value(e[1], known))
        if kind in ("contains", "starts", "ends"):
            a, b = self.value(e[1], known), self.value(e[2], known)
            return {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[kind](a, b)
        if kind == "compare":
            return self.compare(e, known)
        if kind == "math":
            a, b = (self.number(x, known) for x in e[2:])
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[e[1]]()
        if kind == "call":
            return self.call(e, known)
        raise CypherError(f"{kind} cannot stand here")

    def number(self, e, known: set[str]) -> Column:
        c = self.value(e, known)
        return c.try_cast("double") if e[0] == "property" else c

    def compare(self, e, known: set[str]) -> Column:
        _, op, left, right = e
        numeric = any(x[0] == "math" or x[0] == "value" and isinstance(x[1], int | float) and not isinstance(x[1], bool) or x[0] == "parameter" and isinstance(self.parameters.get(x[1]), int | float) for x in (left, right))
        a, b = (self.number(x, known) if numeric else identity(self.value(x, known), self.kind(x)) for x in (left, right))
        return {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))}[op]()

    def call(self, e, known: set[str]) -> Column:
        _, name, distinct, args = e
        if name == "count":
            if args == [("star",)]:
                return F.coalesce(F.sum("__n"), F.lit(0).cast("long")) if self.weighted else F.count("*")
            c = identity(self.value(args[0], known), self.kind(args[0]))
            return F.count_distinct(c) if distinct else F.count(c)
        if name == "collect":
            c = self.plain(args[0], known)
            return F.collect_set(c) if distinct else F.collect_list(c)
        if name in ("sum", "avg"):
            return getattr(F, name)(self.number(args[0], known))
        if name in ("min", "max"):
            return getattr(F, name)(self.value(args[0], known))
        values = [self.value(a, known) for a in args]
        if name in TEXT_CALLS or name in PLAIN_CALLS:
            return (TEXT_CALLS.get(name) or PLAIN_CALLS[name])(*values)
        if name in ("id", "labels", "type"):
            return values[0][name]
        if name in ("nodes", "relationships", "rels"):
            if self.kind(args[0]) != "path":
                raise CypherError(f"{name} takes a path")
            return values[0]["nodes" if name == "nodes" else "relationships"]
        if name in ("length", "size", "reverse"):
            if self.kind(args[0]) == "path":
                return F.size(values[0]["relationships"])
            if name == "reverse":
                return F.reverse(values[0])
            return F.length(values[0]) if self.is_text(args[0]) else F.size(values[0])
        if name == "properties":
            return sorted_map(values[0]["properties"])
        if name in ("tointeger", "tofloat"):
            number = values[0].cast("string").try_cast("double")
            return number.try_cast("long") if name == "tointeger" else number
        if name == "toboolean":
            return F.lower(values[0].cast("string")).try_cast("boolean")
        if name == "head":
            return F.get(values[0], F.lit(0))
        if name == "last":
            return F.get(values[0], F.size(values[0]) - 1)
        if name == "tail":
            return F.slice(values[0], F.lit(2), F.greatest(F.size(values[0]) - 1, F.lit(0)))
        if name == "range":
            first, end, step = (v.cast("long") for v in [*values, F.lit(1)][:3])
            return F.when((end - first) * step >= 0, F.sequence(first, end, step)).otherwise(F.array().cast("array<bigint>"))
        if name == "split":
            return F.split(values[0], F.regexp_replace(values[1], r"([^\w\s])", r"\\$1"))
        if name == "replace":
            return F.replace(*values)
        if name == "substring":
            first = values[1].cast("int") + 1
            return F.substring(values[0], first, values[2].cast("int") if len(values) > 2 else F.length(values[0]))
        if name == "round":
            return F.floor(self.number(args[0], known) + 0.5).cast("double") if len(args) == 1 else F.round(self.number(args[0], known), int(args[1][1]))
        raise CypherError(f"function {name} is not known")

    def each(self, e, known: set[str]) -> Column:
        _, name, source, test, made = e
        kind = self.kind(source)
        before = self.kinds, self.local

        def within(expression, shape):
            def of(x: Column) -> Column:
                self.kinds = {k: v for k, v in before[0].items() if k != name} | ({name: kind[:-1]} if kind in ("nodes", "edges") else {})
                self.local = before[1] | {name: x}
                try:
                    return shape(expression, known)
                finally:
                    self.kinds, self.local = before

            return of

        out = self.value(source, known)
        if test is not None:
            out = F.filter(out, within(test, self.value))
        return F.transform(out, within(made, self.plain)) if made is not None else out

    def is_text(self, e) -> bool:
        """Whether a value is known to be text, not a list."""
        if e[0] == "variable" and e[1] not in self.local:
            return isinstance(self.types.get(e[1]), T.StringType)
        return e[0] == "property" or e[0] == "value" and isinstance(e[1], str) or e[0] == "call" and (e[1] in TEXT_CALLS or e[1] in ("type", "id", "replace", "substring")) or e[0] == "parameter" and isinstance(self.parameters.get(e[1]), str)

    def kind(self, e) -> str | None:
        """node, edge, nodes, edges or path; None for plain values."""
        if e[0] == "variable":
            return self.kinds.get(e[1])
        if e[0] == "call" and e[1] in ("nodes", "relationships", "rels"):
            return "nodes" if e[1] == "nodes" else "edges"
        if e[0] == "at" or e[0] == "call" and e[1] in ("head", "last"):
            of = self.kind(e[1] if e[0] == "at" else e[3][0])
            return of[:-1] if of in ("nodes", "edges") else None
        if e[0] == "call" and e[1] in ("tail", "reverse") or e[0] == "each" and e[4] is None:
            of = self.kind(e[3][0] if e[0] == "call" else e[2])
            return of if of in ("nodes", "edges") else None
        return None

    def plain(self, e, known: set[str]) -> Column:
        return shown(self.value(e, known), self.kind(e))

    # clauses

    def rows(self, df: DataFrame | None) -> DataFrame:
        return self.graph.nodes.sparkSession.range(1).select(F.lit(1).alias("__one")) if df is None else df

    def bound(self, df: DataFrame | None) -> list[str]:
        return [] if df is None else [c for c in df.columns if not c.startswith("__")]

    def node_rows(self, node: dict, var: str) -> DataFrame:
        n = self.graph.nodes
        for label in node["labels"]:
            n = n.where(F.array_contains("labels", label))
        for key, e in node["properties"].items():
            n = n.where(F.col("properties")[key] == self.value(e, set()).cast("string"))
        return n.select(F.col("id").alias(f"__{var}"), F.struct("id", "labels", "properties").alias(var))

    def edge_rows(self, edge: dict, var: str) -> DataFrame:
        e = self.graph.edges
        if edge["types"]:
            e = e.where(F.col("type").isin(edge["types"]))
        for key, value in edge["properties"].items():
            e = e.where(F.col("properties")[key] == self.value(value, set()).cast("string"))
        e = e.select("src", "dst", F.struct("src", "dst", "type", "properties").alias(var))
        if edge["direction"] == "in":
            return e.select(F.col("dst").alias("__from"), F.col("src").alias("__to"), var)
        out = e.select(F.col("src").alias("__from"), F.col("dst").alias("__to"), var)
        if edge["direction"] == "both":  # a loop counts once
            out = out.unionByName(e.where("src <> dst").select(F.col("dst").alias("__from"), F.col("src").alias("__to"), var))
        return out

    def match(self, df: DataFrame | None, patterns: list, where, optional: bool) -> DataFrame:
        before = self.bound(df)
        once, keys = df, []
        if optional and before:
            # what matches depends on a row's values only, so equal rows are matched once and joined back
            keys = [f"__#k{i}" for i in range(len(before))]
            once = df.withColumns({k: identity(F.col(f"`{c}`"), self.kinds.get(c)) for k, c in zip(keys, before, strict=True)})
            df = once.dropDuplicates(keys)
        found, used, waiting = df, [], list(patterns)
        alone = sum(len(chain) // 2 for _, chain in patterns) == 1
        while waiting:
            known = set(self.bound(found))
            tied = [p for p in waiting if known & {x["var"] for x in p[1]}]
            pattern = tied[0] if tied else waiting[0]
            if found is not None and not tied and not self.few and not self.graph.cross:
                new = {x["var"] for x in pattern[1]} - {None}
                if not any(e[0] == "compare" and e[1] == "=" and any(variables(a) and variables(b) and variables(a) <= known and variables(b) <= new for a, b in (e[2:], e[:1:-1])) for e in conjuncts(where)):
                    raise CypherError("nothing ties these patterns together: name a common variable, state an equality between them, or open the graph with cross")
            waiting.remove(pattern)
            found, edges = self.chain(found, *pattern, alone, where)
            self.few = False
            used += edges
        for i, (a, some, types) in enumerate(used):
            for b, others, kinds in used[:i]:
                if types and kinds and not set(types) & set(kinds):
                    continue
                if some and others:
                    found = found.where(~F.arrays_overlap(a, b))
                elif some or others:
                    found = found.where(~F.array_contains(*((a, b) if some else (b, a))))
                else:
                    found = found.where(a != b)
        for e in conjuncts(where):
            if not (self.weighted and variables(e) <= {patterns[0][1][0]["var"]}):  # those of a start that is gone were judged there
                found = found.where(self.value(e, set(self.bound(found))))
        new = [f"`{c}`" for c in self.bound(found) if c not in before and not c.startswith("#")]
        if not optional:
            return found.select(*[f"`{c}`" for c in before], *new, *["__n"] * self.weighted)
        if not before:
            return self.rows(None).join(found.select(*new), F.lit(True), "left").drop("__one")
        far = found.select(*[F.col(f"`{k}`").alias(f"__f{k[2:]}") for k in keys], *new)
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__f{k[2:]}`")) for k in keys]
        return once.join(far, same, "left").select(*[f"`{c}`" for c in before], *new)

    def chain(self, df: DataFrame | None, path: str | None, chain: list, alone: bool, where=None) -> tuple[DataFrame, list[tuple]]:
        """df joined with a pattern; also what edges it uses: (identities, whether these are lists, types).

        What of ``where`` is about a new start alone is asked there already, before any path is made.
        """
        known = set(self.bound(df))
        names = [x["var"] or f"#{'e' if k % 2 else 'n'}{next(self.fresh)}" for k, x in enumerate(chain)]
        begin = next((k for k in range(0, len(chain), 2) if names[k] in known), 0)
        if names[begin] in known:
            df = self.narrowed(df, chain[begin], names[begin])
        else:
            self.kinds[names[begin]] = "node"
            start = self.node_rows(chain[begin], names[begin]).drop(f"__{names[begin]}")
            for e in conjuncts(where):
                if variables(e) == {names[begin]}:
                    start = start.where(self.value(e, {names[begin]}))
            df = start if df is None else df.crossJoin(start)
        used: list[tuple] = []
        flipped = {"in": "out", "out": "in", "both": "both"}
        for k, step in [*((k, 1) for k in range(begin + 1, len(chain), 2)), *((k, -1) for k in range(begin - 1, 0, -2))]:
            at, edge, to = names[k - step], chain[k], names[k + step]
            if step < 0:
                edge = edge | {"direction": flipped[edge["direction"]]}
            if edge["steps"]:
                df, identities = self.walk(df, at, edge, chain[k + step], to, names[k], step, path is not None, alone)
                if identities is not None:
                    used.append((identities, True, edge["types"]))
            else:
                self.kinds[names[k]] = "edge"
                hop = self.edge_rows(edge, names[k])
                df = df.join(hop, F.col(f"`{at}`")["id"] == F.col("__from")).drop("__from")
                df = self.arrive(df, chain[k + step], to)
                used.append((edge_identity(F.col(f"`{names[k]}`")), False, edge["types"]))
        if path is not None:
            one = lambda n: F.array(F.col(f"`{n}`"))
            nodes, edges = [one(names[0])], []
            for k in range(1, len(chain), 2):
                walked = bool(chain[k]["steps"])
                nodes += [F.col(f"`__#m{names[k]}`")] * walked + [one(names[k + 1])]
                edges.append(F.col(f"`{names[k]}`") if walked else one(names[k]))
                if walked:  # a walk of no step ends where it begins
                    nodes[-1] = F.when(F.size(edges[-1]) > 0, nodes[-1]).otherwise(F.array().cast(f"array<{NODE}>"))
            empty = F.array().cast(f"array<{EDGE}>")
            df = df.withColumn(path, F.struct(F.concat(*nodes).alias("nodes"), F.concat(empty, *edges).alias("relationships")))
            self.kinds[path] = "path"
        return df, used

    def arrive(self, df: DataFrame, node: dict, to: str) -> DataFrame:
        """Binds the node at column __to."""
        if to in self.bound(df):
            df = df.where(F.col("__to") == F.col(f"`{to}`")["id"]).drop("__to")
            return self.narrowed(df, node, to)
        self.kinds[to] = "node"
        return df.join(self.node_rows(node, to), F.col("__to") == F.col(f"`__{to}`")).drop("__to", f"__{to}")

    def narrowed(self, df: DataFrame, node: dict, var: str) -> DataFrame:
        c = F.col(f"`{var}`")
        for label in node["labels"]:
            df = df.where(F.array_contains(c["labels"], label))
        for key, e in node["properties"].items():
            df = df.where(c["properties"][key] == self.value(e, set()).cast("string"))
        return df

    def walk(self, df: DataFrame, at: str, edge: dict, node: dict, to: str, name: str, step: int, path: bool, alone: bool) -> tuple[DataFrame, Column | None]:
        """Paths of several steps that use no edge twice, one row for each path, and the identities of their edges.

        step -1: the pattern is walked from its end. path: the nodes between the ends are kept, in the pattern's order.
        """
        low, high = edge["steps"]
        hop = self.edge_rows(edge, "__hop")
        named = not name.startswith("#")
        if self.counted:
            self.weighted = True
            self.kinds.pop(at)
            return self.arrive(self.numbers(df, at, hop, low, high), node, to), None
        if self.once and alone and not path and not named and edge["direction"] != "both" and low <= 1 and (high is None or high > 1):
            return self.arrive(self.reached(df, at, hop, low, high), node, to), None
        rounds = high is None or high > UNROLLED
        here = F.col(f"`{at}`")["id"]
        uses, mids = f"__#u{name}", f"__#m{name}"
        grown = df.select(here.alias("__start")).distinct() if rounds else df.withColumn("__start", here)
        grown = grown.withColumns({"__to": F.col("__start"), uses: F.array().cast(f"array<{EDGE_IDENTITY}>")})
        if path or named:
            grown = grown.withColumns({name: F.array().cast(f"array<{EDGE}>")} | ({mids: F.array().cast(f"array<{NODE}>")} if path else {}))
        out = [grown] if low == 0 else []
        n = 0
        while high is None or n < high:
            n += 1
            before = grown.withColumnRenamed("__to", "__here")
            if path and n > 1:
                mid = self.node_rows({"labels": [], "properties": {}}, "__mid").select(F.col("____mid").alias("__mid_id"), "__mid")
                before = before.join(mid, F.col("__here") == F.col("__mid_id")).drop("__mid_id")
                before = before.withColumn(mids, F.concat(*self.ordered(F.col(f"`{mids}`"), F.array("__mid"), step))).drop("__mid")
            used = edge_identity(F.col("__hop"))
            grown = before.join(hop, F.col("__here") == F.col("__from")).where(~F.array_contains(f"`{uses}`", used))
            made = {uses: F.array_append(f"`{uses}`", used)}
            if path or named:
                made[name] = F.concat(*self.ordered(F.col(f"`{name}`"), F.array("__hop"), step))
            grown = grown.withColumns(made).drop("__here", "__from", "__hop")
            if rounds:
                grown = written(grown, "paths")
                if grown.isEmpty():
                    break
            if n >= low:
                out.append(grown)
        found = reduce(lambda a, b: a.unionByName(b), out) if out else grown
        if rounds:
            found = df.join(found, here == F.col("__start"))
        if path or named:
            self.kinds[name] = "edges"
        return self.arrive(found.drop("__start"), node, to), F.col(f"`{uses}`")

    def numbers(self, df: DataFrame, at: str, hop: DataFrame, low: int, high: int | None) -> DataFrame:
        """(__to, __n): how many paths of the pattern, from any of df's nodes, end there.

        Paths that stand at one node and have used the same edges of those that a path can come to twice go on alike, so they
        are one row with their number. An edge is come to once only if nothing leads to its start or nothing leads on from its
        end; these are taken off round by round, and what is left need not lie on a cycle: the list of used edges then only
        tells more paths apart than it must. All edges are read for the first step; further ones are those that start where
        some edge ends.
        """
        hop = written(hop.select("__from", "__to", edge_identity(F.col("__hop")).alias("__e")), "edges")
        later = written(hop.join(hop.select(F.col("__to").alias("__from")).distinct(), "__from", "left_semi"), "edges-later")
        again, size = later, later.count()
        while size:
            again = again.join(again.select(F.col("__to").alias("__from")).distinct(), "__from", "left_semi")
            again = written(again.join(again.select(F.col("__from").alias("__to")).distinct(), "__to", "left_semi"), "edges-again")
            left = again.count()
            if 2 * left > size and left:  # the rest is a cycle, or long chains not worth more rounds
                break
            size = left
        marks = again.select("__from", "__to", F.col("__e").alias("__used"))
        uses = [F.col("__from"), F.col("__to"), F.col("__e")]
        marked = lambda e: e.join(marks.withColumnsRenamed({"__from": "__f", "__to": "__t"}).dropDuplicates(["__f", "__t", "__used"]), (F.col("__from") == F.col("__f")) & (F.col("__to") == F.col("__t")) & (F.col("__e") == F.col("__used")), "left").select(*uses, "__used")
        no_edges = F.array().cast(f"array<{EDGE_IDENTITY}>")
        grown = df.select(F.col(f"`{at}`")["id"].alias("__to")).groupBy("__to").agg(F.count("*").alias("__n")).withColumn("__uses", no_edges)
        out, n = [grown] if low == 0 else [], 0
        # nothing comes back to an edge that is not among the later ones; only these are looked up in the rest
        later = written(marked(later), "edges-marked") if size else later.withColumn("__used", F.lit(None).cast(EDGE_IDENTITY))
        while high is None or n < high:
            n += 1
            edges = later if n > 1 else hop.join(later.select("__from").distinct(), "__from", "left_anti").withColumn("__used", F.lit(None).cast(EDGE_IDENTITY)).unionByName(later)
            here = grown.withColumnRenamed("__to", "__here").join(edges, F.col("__here") == F.col("__from"))
            free = here.where(F.col("__used").isNull() | ~F.array_contains("__uses", F.col("__used")))
            more = F.when(F.col("__used").isNull(), F.col("__uses")).otherwise(F.array_sort(F.array_append("__uses", F.col("__used"))))
            grown = written(free.select("__to", "__n", more.alias("__uses")).groupBy("__to", "__uses").agg(F.sum("__n").alias("__n")), "numbers")
            if grown.isEmpty():
                break
            if n >= low:
                out.append(grown)
        found = reduce(lambda a, b: a.unionByName(b), out) if out else grown
        return found.groupBy("__to").agg(F.sum("__n").alias("__n"))

    @staticmethod
    def ordered(so_far: Column, new: Column, step: int) -> tuple[Column, Column]:
        return (so_far, new) if step > 0 else (new, so_far)

    def reached(self, df: DataFrame, at: str, hop: DataFrame, low: int, high: int | None) -> DataFrame:
        """df with each end that some path of the pattern reaches, once, as __to."""
        here = F.col(f"`{at}`")["id"]
        edges = hop.select("__from", F.col("__to").alias("__next")).distinct()
        fresh = written(df.select(here.alias("__start"), here.alias("__to")).distinct(), "reached")
        seen = fresh if low == 0 else None
        n, check = 0, 1
        while high is None or n < high:
            n += 1
            grown = fresh.join(edges, F.col("__to") == F.col("__from")).select("__start", F.col("__next").alias("__to")).distinct()
            # looking up all pairs each round would read them once a round; pairs that come back in between go on for less than
            # as many rounds again, and are one in the end
            if n >= check and seen is not None:
                grown, check = grown.join(seen, ["__start", "__to"], "left_anti"), 2 * n
            fresh = written(grown, "reached")
            if fresh.isEmpty():
                break
            seen = fresh if seen is None else seen.unionByName(fresh)
        return df.join(fresh if seen is None else seen.distinct(), here == F.col("__start")).drop("__start")

    def unwind(self, df: DataFrame | None, e, name: str) -> DataFrame:
        rows = self.rows(df)
        kind = self.kind(e)
        out = rows.withColumn(name, F.explode(self.value(e, set(self.bound(df))))).select(*[f"`{c}`" for c in dict.fromkeys([*self.bound(df), name])])
        self.kinds.pop(name, None)
        if kind in ("nodes", "edges"):
            self.kinds[name] = kind[:-1]
        return out

    def project(self, df, kind: str, distinct: bool, items: list, order: list, skip, limit, where) -> DataFrame:
        if items and items[0][0] == ("star",):
            items = [(("variable", c), c, "variable") for c in self.bound(df)] + items[1:]
        df = self.rows(df)
        known = set(self.bound(df))
        names = [label for _, label, _ in items]
        kept = {label: self.kind(e) for e, label, _ in items if self.kind(e)}
        # things stay whole within WITH; a result has them as JSON
        last = {n: shown(F.col(f"`{n}`"), kept.get(n) if kind == "return" else None).alias(n) for n in names}
        if any(aggregates(e) for e, _, _ in items):
            keys = [(e, label) for e, label, _ in items if not aggregates(e)]
            totals = [self.value(e, known).alias(label) for e, label, _ in items if aggregates(e)]
            firsts = [F.first(self.value(e, known)).alias(label) for e, label in keys if label in kept]
            by = [identity(self.value(e, known), kept.get(label)).alias(f"__#{label}" if label in kept else label) for e, label in keys]
            self.few = self.few or not by
            out = (df.groupBy(*by) if by else df.groupBy()).agg(*totals, *firsts).select(*[f"`{n}`" for n in names])
            scope, self.weighted = set(names), False
        else:
            made = [self.value(e, known).alias(label) for e, label, _ in items]
            out = df.select(*[f"`{c}`" for c in df.columns if c not in names], *made) if order and not distinct else df.select(*made)
            scope = set(out.columns)
            if distinct:
                out = out.withColumns({f"__#{n}": identity(F.col(f"`{n}`"), k) for n, k in kept.items()}).dropDuplicates([f"__#{n}" if n in kept else n for n in names])
        self.kinds = {n: k for n, k in self.kinds.items() if n not in names} | kept
        if order:
            labels = {repr(e): label for e, label, _ in items}
            by = []
            for e, down in order:
                named = ("variable", labels[repr(e)]) if repr(e) in labels else e
                c = identity(self.value(named, scope), self.kind(named))
                by.append(c.desc_nulls_first() if down else c.asc_nulls_last())
            out = out.orderBy(*by)
        whole = lambda e: int(e[1]) if e[0] == "value" else int(self.parameters[e[1]])
        if skip is not None:
            out = out.offset(whole(skip))
        if limit is not None:
            out = out.limit(whole(limit))
            self.few = self.few or whole(limit) <= FEW
        out = out.select(*last.values())
        self.kinds = kept if kind == "with" else {}
        return out.where(self.value(where, set(names))) if where is not None else out
