"""Graph patterns: terms, patterns, rules, and their text form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from quadspark.functions.terms import Value


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Any_:
    """Matches anything and binds nothing; every match is a row."""


ANY = Any_()
Slot = Var | Value | Any_


@dataclass(frozen=True)
class Graph:
    """Where a pattern looks: union of all graphs, one, a set, or any named one bound to a variable."""

    kind: str = "union"  # union | one | set | named | set-named (some named ones) | all (each graph apart)
    iris: tuple[str, ...] = ()
    var: str | None = None


UNION, DEFAULT = Graph(), Graph("one", ("",))


@dataclass(frozen=True)
class Pattern:
    """One triple pattern. ``hops`` (least, most) makes it a path of its predicate; most None is unbounded."""

    s: Slot
    p: Slot
    o: Slot
    graph: Graph = UNION
    edge: str | None = None
    hops: tuple[int, int | None] | None = None
    nodes_only: bool = False  # an object variable then binds nodes only

    def vars(self) -> list[str]:
        names = [t.name for t in (self.s, self.p, self.o) if isinstance(t, Var)]
        names += [n for n in (self.graph.var, self.edge) if n]
        return list(dict.fromkeys(names))


@dataclass(frozen=True)
class Rule:
    """``head(s, o) :- body``: derived predicates are read from rules only, never from storage."""

    head: str
    s: str
    o: str
    body: tuple[Pattern, ...]


@dataclass
class Query:
    patterns: list[Pattern]
    rules: list[Rule] = field(default_factory=list)

    def scoped(self, graph: Graph) -> Query:
        """Unscoped patterns, also in rule bodies, look in ``graph``; derived predicates have no graph."""
        derived = {r.head for r in self.rules}

        def scope(p: Pattern) -> Pattern:
            own = isinstance(p.p, Value) and p.p.value in derived
            return replace(p, graph=graph) if p.graph == UNION and not own else p

        return Query([scope(p) for p in self.patterns], [replace(r, body=tuple(map(scope, r.body))) for r in self.rules])


_UUID = re.compile(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?|<[^>]*>|\S+')


def parse_pattern(text: str, vocabulary=None) -> Pattern:
    """``?s :p ?o @<g>``: variables, ``_``, names, IRIs, UUIDs, literals; ``@default``, ``@?g``, ``@<iri>``."""
    tokens = _TOKEN.findall(text)
    graph = UNION
    if len(tokens) == 4 and tokens[3].startswith("@"):
        where = tokens.pop()[1:]
        graph = DEFAULT if where == "default" else Graph("named", var=where[1:]) if where.startswith("?") else Graph("one", (where.strip("<>"),))
    if len(tokens) != 3:
        raise ValueError(f"a pattern has three terms and perhaps a graph: {text!r}")
    s, p, o = (parse_slot(t, vocabulary) for t in tokens)
    return Pattern(s, p, o, graph)


def parse_slot(token: str, vocabulary=None) -> Slot:
    from quadspark.functions.terms import parse_literal

    if token.startswith("?"):
        return Var(token[1:])
    if token == "_":
        return ANY
    if token.startswith("<"):
        return Value("U", token[1:-1])
    if token.startswith('"'):
        body, _, tail = token[1:].rpartition('"')
        body = body.replace('\\"', '"').replace("\\\\", "\\")
        return parse_literal(body, tail[1:] if tail.startswith("@") else None, tail[3:-1] if tail.startswith("^^") else None)
    if re.fullmatch(r"[+-]?\d+", token):
        return Value("I", int(token))
    if re.fullmatch(r"[+-]?\d*\.\d+([eE][+-]?\d+)?", token):
        return Value("D", float(token))
    if _UUID.match(token):
        return Value("U", f"urn:uuid:{token.lower()}")
    name = token[1:] if token.startswith(":") else token
    return Value("U", vocabulary.expand(name) if vocabulary else name)


@dataclass
class Vocabulary:
    """A base for bare names and prefixes for the rest; both may change at any time."""

    base: str = "urn:q:vocab:"
    prefixes: dict[str, str] = field(default_factory=dict)

    def put(self, prefix: str, iri: str) -> None:
        self.prefixes[prefix] = iri

    def remove(self, prefix: str) -> None:
        self.prefixes.pop(prefix, None)

    def expand(self, name: str) -> str:
        prefix, colon, local = name.partition(":")
        if not colon:
            return self.base + name
        return self.prefixes[prefix] + local if prefix in self.prefixes and not local.startswith("//") else name

    def compact(self, iri: str) -> str:
        """The shortest name: a bare one under the base, else by the longest prefix."""
        found = [(len(ns), f"{p}:{iri[len(ns):]}") for p, ns in self.prefixes.items() if iri.startswith(ns)]
        found += [(len(self.base), iri[len(self.base) :])] if iri.startswith(self.base) else []
        return max(found)[1] if found else iri

    def fingerprint(self) -> tuple:
        return self.base, tuple(sorted(self.prefixes.items()))
