"""RDF in and out: N-Triples, N-Quads, Turtle, TriG and JSON-LD.

Line formats are parsed with column expressions; documents that must be read as a whole are parsed one
file a row. Blank nodes become IRIs under ``{base}/.well-known/genid/{import}/{label}``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.functions import terms
from quadspark.functions.terms import RDF, RDF_TYPE, Value, parse_literal
from quadspark.operators.snapshot import edge_id
from quadspark.plans.patterns import Var
from quadspark.plans.sparql_parser import Parser

GENID = "/.well-known/genid/"

#: Stand for an escaped backslash and quote while a line is taken apart, so that no pattern needs a choice
#: in a loop (which would take a stack frame a character). Noncharacters; a line that has them is malformed.
_MASKS = "\ufdd0\ufdd1"
_IRI, _BLANK = r"<([^<>\"{}|^`\s]*)>", r"_:([A-Za-z0-9_][\w.-]*)"
_LITERAL = r'"([^"]*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\s]*)>)?'
#: Escapes that are none, and halves of surrogate pairs.
_HIGH, _LOW = r"\\u[dD][89abAB][0-9A-Fa-f]{2}", r"\\u[dD][c-fC-F][0-9A-Fa-f]{2}"
_WRONG = rf"\\(?!u[0-9A-Fa-f]{{4}}|U(?:000[0-9A-Fa-f]|0010)[0-9A-Fa-f]{{4}}|[tbnrf'])|{_HIGH}(?!{_LOW})|(?<!{_HIGH}){_LOW}"
_LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(?:{_IRI}|{_BLANK}|{_LITERAL})\s*(?:{_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"


def skolem(base: str, import_id: str, label: Column) -> Column:
    return F.concat(F.lit(f"{base}{GENID}{import_id}/"), label)


#: The escapes of one character in the line formats.
_SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", "'": "'"}


def _unescaped(c: Column) -> Column:
    """String escapes of a masked part of a line, of one character or of 4 or 8 hex digits.

    The text is cut into escapes and what stands between them, and each part becomes what it stands for;
    two escapes that make a surrogate pair are one part.
    """
    parts = F.regexp_extract_all(c, F.lit(rf"{_HIGH}{_LOW}|\\U[0-9A-Fa-f]{{8}}|\\u[0-9A-Fa-f]{{4}}|(?s:\\.)|[^\\]+"), F.lit(0))
    number = lambda x, at, n: F.conv(F.substring(x, at, n), 16, 10).cast("long")

    def char(code: Column) -> Column:
        """The character of a code point, by way of UTF-32 bytes after their mark."""
        return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")

    def one(x: Column) -> Column:
        out = F.when(F.length(x) == 12, char(F.lit(0x10000) + (number(x, 3, 4) - 0xD800) * 1024 + number(x, 9, 4) - 0xDC00))
        out = out.when(F.startswith(x, F.lit("\\U")), char(number(x, 3, 8))).when(F.startswith(x, F.lit("\\u")), char(number(x, 3, 4)))
        for name, value in _SHORT.items():
            out = out.when(x == "\\" + name, F.lit(value))
        return out.otherwise(x)

    escaped = lambda x: F.when(F.startswith(x, F.lit("\\")), one(x)).otherwise(x)
    text = F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, escaped), "")).otherwise(c)
    return F.translate(text, _MASKS, '\\"')


def read_lines(spark: SparkSession, path: str, base: str = "urn:q", import_id: str = "0", graph: str = "") -> tuple[DataFrame, DataFrame]:
    """Quads of an N-Triples or N-Quads file or folder, and its malformed lines ``(value)``."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    masked = F.replace(F.replace("value", F.lit("\\\\"), F.lit(_MASKS[0])), F.lit('\\"'), F.lit(_MASKS[1]))
    lines = lines.withColumn("__line", masked)
    part = lambda n: F.nullif(F.regexp_extract("__line", _LINE, n), F.lit(""))
    good = F.col("__line").rlike(_LINE) & ~F.col("__line").rlike(_WRONG) & ~F.col("value").rlike(f"[{_MASKS}]")
    iri = lambda n: _unescaped(part(n))
    s = F.coalesce(iri(1), skolem(base, import_id, part(2)))
    o_node = F.coalesce(iri(4), skolem(base, import_id, part(5)))
    # an empty text is not a missing one
    text = _unescaped(F.regexp_extract("__line", _LINE, 6))
    o = F.when(o_node.isNotNull(), terms.node(o_node)).otherwise(terms.literal(text, part(7), iri(8)))
    g = F.coalesce(iri(9), skolem(base, import_id, part(10)), F.lit(graph))
    rows = lines.where(good).select(g.alias("g"), s.alias("s"), iri(3).alias("p"), o.alias("o"))
    return with_edges(rows), lines.where(~good).select("value")


def with_edges(rows: DataFrame) -> DataFrame:
    return rows.withColumn("edge_id", F.when(F.col("o.kind") == "U", edge_id(F.col("s"), F.col("p"), F.col("o.key"))))


class _Turtle(Parser):
    """Turtle and TriG on the tokens of the query parser."""

    def __init__(self, text: str, graph: str, blank):
        super().__init__(_with_sparql_directives(text))
        self.rows: list[tuple] = []
        self.at_graph, self.blank = graph, blank

    def document(self) -> list[tuple]:
        while self.peek()[0] != "end":
            self.prologue()
            if self.peek()[0] == "end":
                break
            if self.peek()[1] == "{" or self.word("GRAPH") or (self.peek()[0] in ("iri", "pname", "bnode") and self.peek(1)[1] == "{"):
                outer = self.at_graph
                self.eat("GRAPH")
                self.at_graph = outer if self.peek()[1] == "{" else self.node().value
                self.need("{")
                while not self.eat("}"):
                    self.statement()
                    self.eat(".")
                self.at_graph = outer
            else:
                self.statement()
                self.need(".")
        return self.rows

    def statement(self) -> None:
        bare = self.peek()[1] == "["
        s = self.node()
        if not (bare and self.peek()[1] in (".", "}")):
            self.predicates(s)

    def predicates(self, s: Value) -> None:
        while True:
            p = RDF_TYPE if self.peek() == ("word", "a") and self.next() else self.iri()
            while True:
                self.rows.append((self.at_graph, s.value, p, self.node()))
                if not self.eat(","):
                    break
            while self.eat(";"):
                pass
            if self.peek()[1] in (".", "]", "}") or self.peek()[0] == "end":
                return

    def node(self) -> Value:
        kind, text = self.peek()
        if self.eat("["):
            out = self.blank(f"b{next(self.fresh)}x")
            if not self.eat("]"):
                self.predicates(out)
                self.need("]")
            return out
        if self.eat("("):
            items = []
            while not self.eat(")"):
                items.append(self.node())
            cells = [self.blank(f"l{next(self.fresh)}x") for _ in items] + [Value("U", RDF + "nil")]
            for n, item in enumerate(items):
                self.rows.append((self.at_graph, cells[n].value, RDF + "first", item))
                self.rows.append((self.at_graph, cells[n].value, RDF + "rest", cells[n + 1]))
            return cells[0]
        if kind == "bnode":
            self.next()
            return self.blank(text[2:])
        out = self.term()
        if isinstance(out, Var):
            raise SyntaxError("no variables in data")
        if out.kind == "D" and kind == "num" and "e" not in text.lower():
            return Value("D", out.value)
        return out


def _with_sparql_directives(text: str) -> str:
    return re.sub(r"@(prefix|base)\b([^>]*>)\s*\.", lambda m: f"{m[1].upper()}{m[2]}", text)


def parse_turtle(text: str, graph: str = "", base: str = "urn:q", import_id: str = "0") -> list[tuple[str, str, str, Value]]:
    """``(g, s, p, o)`` of a Turtle or TriG document."""
    return _Turtle(text, graph, lambda label: Value("U", f"{base}{GENID}{import_id}/{label}")).document()


def parse_jsonld(text: str, graph: str = "", base: str = "urn:q", import_id: str = "0") -> list[tuple[str, str, str, Value]]:
    """``(g, s, p, o)`` of a JSON-LD document: @context with prefixes and terms, @graph, @id, @type, @value, @list."""
    rows: list[tuple] = []
    count = iter(range(1 << 62))

    def expand(name: str, context: dict, vocab: bool = True) -> str:
        to = context.get(name)
        to = to.get("@id") if isinstance(to, dict) else to
        if vocab and to:
            return expand(to, {k: v for k, v in context.items() if k != name}, vocab)
        prefix, colon, local = name.partition(":")
        if colon and not local.startswith("//") and isinstance(context.get(prefix), str):
            return context[prefix] + local
        return name if colon or not vocab else context.get("@vocab", "") + name

    def node_id(name: str | None, context: dict) -> str:
        if name is None or name.startswith("_:"):
            label = name[2:] if name else f"j{next(count)}x"
            return f"{base}{GENID}{import_id}/{label}"
        return expand(name, context, False)

    def value(x, context: dict, g: str, kind: str | None) -> Value | None:
        if isinstance(x, bool) or isinstance(x, (int, float)):
            return Value.of(x)
        if isinstance(x, str):
            return Value("U", node_id(x, context)) if kind == "@id" else parse_literal(x, None, expand(kind, context)) if kind else Value("S", x)
        if "@value" in x:
            v = x["@value"]
            if not isinstance(v, str) and "@type" not in x:
                return Value.of(v)
            shown = str(v).lower() if isinstance(v, bool) else str(v)
            return parse_literal(shown, x.get("@language"), expand(x["@type"], context) if "@type" in x else None)
        return Value("U", walk(x, context, g))

    def walk(x: dict, context: dict, g: str) -> str:
        own = x.get("@context")
        for c in own if isinstance(own, list) else [own]:
            context = {**context, **(c or {})}
        s = node_id(x.get("@id"), context)
        inner = x.get("@graph")
        if inner is not None:
            for item in inner if isinstance(inner, list) else [inner]:
                walk(item, context, s if "@id" in x else g)
        for t in [x["@type"]] if isinstance(x.get("@type"), str) else x.get("@type", []):
            rows.append((g, s, RDF_TYPE, Value("U", expand(t, context))))
        for key, values in x.items():
            if key.startswith("@"):
                continue
            definition = context.get(key)
            kind = definition.get("@type") if isinstance(definition, dict) else None
            for v in values if isinstance(values, list) else [values]:
                for item in v["@list"] if isinstance(v, dict) and "@list" in v else [v]:
                    if item is not None:
                        rows.append((g, s, expand(key, context), value(item, context, g, kind)))
        return s

    # one document, or one object a line as :func:`jsonld` writes them
    decoder, at = json.JSONDecoder(), 0
    while at < len(text.rstrip()):
        at += len(text[at:]) - len(text[at:].lstrip())
        data, at = decoder.raw_decode(text, at)
        for item in data if isinstance(data, list) else [data]:
            walk(item, {}, graph)
    return rows


def quads_of(spark: SparkSession, rows: list[tuple[str, str, str, Value]]) -> DataFrame:
    """A small list of parsed quads as a DataFrame."""
    plain = [(g, s, p, *_parts(o)) for g, s, p, o in rows]
    return with_edges(_from_parts(spark.createDataFrame(plain, _PARTS_DDL)))


_PARTS_DDL = "g string, s string, p string, kind string, str string, int bigint, dbl double, bool boolean, extra string"


def _parts(o: Value) -> tuple:
    text = o.value if o.kind in "USLT" else None
    return o.kind, text, o.value if o.kind == "I" else None, o.value if o.kind == "D" else None, o.value if o.kind == "B" else None, o.extra


def _from_parts(df: DataFrame) -> DataFrame:
    k, c = F.col("kind"), F.col
    o = (
        F.when(k == "U", terms.node(c("str"))).when(k == "S", terms.text(c("str"))).when(k == "I", terms.integer(c("int"))).when(k == "D", terms.double(c("dbl")))
        .when(k == "B", terms.boolean(c("bool"))).when(k == "L", terms.lang_text(c("str"), c("extra"))).otherwise(terms.typed(c("str"), c("extra")))
    )
    return df.select("g", "s", "p", o.alias("o"))


def read_documents(spark: SparkSession, path: str, kind: str, base: str = "urn:q", import_id: str = "0", graph: str = "") -> DataFrame:
    """Quads of Turtle, TriG or JSON-LD files, each parsed as a whole."""
    parse = parse_jsonld if kind == "jsonld" else parse_turtle
    files = spark.read.text(path, wholetext=True)

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = [(g, s, p, *_parts(o)) for g, s, p, o in parse(text, graph, base, import_id)]
                yield pa.RecordBatch.from_pylist([dict(zip([n.split()[0] for n in _PARTS_DDL.split(", ")], r, strict=True)) for r in rows], schema=_PARTS)

    return with_edges(_from_parts(files.mapInArrow(run, _PARTS_DDL)))


_PARTS = pa.schema([(n, pa.string()) for n in ("g", "s", "p", "kind", "str")] + [("int", pa.int64()), ("dbl", pa.float64()), ("bool", pa.bool_()), ("extra", pa.string())])

FORMATS = {"nt": "lines", "nq": "lines", "ttl": "turtle", "trig": "turtle", "jsonld": "jsonld"}
#: Formats to write only: with statements about edges as quoted triples.
STAR = ("nts", "ttls")


def read(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    return read_lines(spark, path, **options)[0] if FORMATS[fmt] == "lines" else read_documents(spark, path, FORMATS[fmt], **options)


# --- out -----------------------------------------------------------------------------------------

def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rendered(o: Column) -> Column:
    """A term in the line formats."""
    quoted = F.concat(F.lit('"'), _escaped(terms.lexical(o)), F.lit('"'))
    kind = o["kind"]
    return (
        F.when(kind == "U", F.concat(F.lit("<"), o["str"], F.lit(">"))).when(kind == "S", quoted).when(kind == "L", F.concat(quoted, F.lit("@"), o["lang"]))
        .otherwise(F.concat(quoted, F.lit("^^<"), terms.datatype(o), F.lit(">")))
    )


def _iri(c: str) -> Column:
    return F.concat(F.lit("<"), F.col(c), F.lit(">"))


def lines(quads: DataFrame, graphs: bool = False) -> DataFrame:
    """``(value)``: N-Triples, or N-Quads with ``graphs``."""
    parts = [_iri("s"), _iri("p"), rendered(F.col("o"))]
    tail = F.when(F.col("g") != "", F.concat(_iri("g"), F.lit(" ."))).otherwise(F.lit(".")) if graphs else F.lit(".")
    return quads.select(F.concat_ws(" ", *parts, tail).alias("value"))


def star_lines(quads: DataFrame, annotations: DataFrame) -> DataFrame:
    """``(value)``: annotations as statements about quoted triples, in the syntax of both line and block formats."""
    q = quads.select("edge_id", F.concat_ws(" ", F.lit("<<"), _iri("s"), _iri("p"), rendered(F.col("o")), F.lit(">>")).alias("subject"))
    return annotations.join(q, "edge_id").select(F.concat_ws(" ", "subject", _iri("p"), rendered(F.col("o")), F.lit(".")).alias("value"))


def turtle(quads: DataFrame, prefixes: dict[str, str] | None = None, graphs: bool = False) -> DataFrame:
    """``(g, s, value)``: one block a subject, predicates sorted; TriG blocks with ``graphs``.

    A file begins with :func:`turtle_prefixes`.
    """
    def short(c: Column) -> Column:
        for prefix, ns in sorted((prefixes or {}).items(), key=lambda kv: -len(kv[1])):
            tail = F.substring(c, len(ns) + 1, 1 << 20)
            c = F.when(F.startswith(c, F.lit(ns)) & tail.rlike(r"^[A-Za-z_][\w-]*$"), F.concat(F.lit(f"{prefix}:"), tail)).otherwise(c)
        return F.when(F.col("p").isNotNull() & c.rlike(r"^[A-Za-z][\w-]*:[A-Za-z_][\w-]*$") & c.rlike("^(" + "|".join(map(re.escape, prefixes or {"-": ""})) + "):"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    o = F.when(F.col("o.kind") == "U", short(F.col("o.str"))).otherwise(rendered(F.col("o")))
    p = F.when(F.col("p") == RDF_TYPE, F.lit("a")).otherwise(short(F.col("p")))
    rows = quads.select("g", "s", short(F.col("s")).alias("subject"), F.struct(p.alias("p"), o.alias("o")).alias("x"))
    blocks = rows.groupBy("g", "s", "subject").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: F.concat_ws(" ", x["p"], x["o"])), " ;\n    ")
    block = F.concat("subject", F.lit(" "), body, F.lit(" ."))
    if graphs:
        block = F.when(F.col("g") != "", F.concat(F.lit("<"), F.col("g"), F.lit("> {\n"), block, F.lit("\n}"))).otherwise(block)
    return blocks.select("g", "s", block.alias("value"))


def turtle_prefixes(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in sorted(prefixes.items()))


def jsonld(quads: DataFrame) -> DataFrame:
    """``(g, s, value)``: one JSON object a subject, in expanded form."""
    o = F.col("o")
    literal = F.to_json(F.struct(terms.lexical(o).alias("@value"), o["lang"].alias("@language"), F.when(o["kind"].isin("I", "D", "B", "T"), terms.datatype(o)).alias("@type")))
    shown = F.when(o["kind"] == "U", F.to_json(F.struct(o["str"].alias("@id")))).otherwise(literal)
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, F.length(F.to_json(F.array(c))) - 2)
    types = F.when((F.col("p") == RDF_TYPE) & (o["kind"] == "U"), quoted(o["str"]))
    by_p = quads.groupBy("g", "s", "p").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.coalesce(types, shown))), ","), F.lit("]")).alias("xs"))
    name = F.when(F.col("p") == RDF_TYPE, F.lit('"@type"')).otherwise(quoted(F.col("p")))
    pairs = by_p.groupBy("g", "s").agg(F.array_join(F.array_sort(F.collect_list(F.concat(name, F.lit(":"), F.col("xs")))), ",").alias("body"))
    return pairs.select("g", "s", F.concat(F.lit('{"@id":'), quoted(F.col("s")), F.lit(","), F.col("body"), F.lit("}")).alias("value"))


def write(quads: DataFrame, path: str, fmt: str, prefixes: dict[str, str] | None = None, annotations: DataFrame | None = None) -> None:
    """Text files of a folder; full IRIs throughout, so parts of Turtle and TriG need no header.

    The formats nts and ttls are N-Triples and Turtle with ``annotations`` as quoted triples beside.
    """
    if fmt in STAR:
        plain = lines(quads) if fmt == "nts" else turtle(quads).select("value")
        plain = plain if annotations is None else plain.unionByName(star_lines(quads, annotations))
        plain.write.mode("overwrite").text(path)
    elif fmt in ("nt", "nq"):
        lines(quads, fmt == "nq").write.mode("overwrite").text(path)
    elif fmt in ("ttl", "trig"):
        turtle(quads, None, fmt == "trig").select("value").write.mode("overwrite").text(path)
    else:
        jsonld(quads).select("value").write.mode("overwrite").text(path)


def results_json(df: DataFrame, names: list[str]) -> DataFrame:
    """``(value)``: one SPARQL JSON binding a row, from term columns."""
    def one(n: str) -> Column:
        t = F.col(f"`{n}`")
        return F.when(t["key"].isNotNull(), F.struct(F.when(t["kind"] == "U", "uri").otherwise("literal").alias("type"), terms.lexical(t).alias("value"), t["lang"].alias("xml:lang"), F.when(t["kind"].isin("I", "D", "B", "T"), terms.datatype(t)).alias("datatype")))

    return df.select(F.to_json(F.struct(*[one(n).alias(n) for n in names])).alias("value"))


def results_document(df: DataFrame, names: list[str]) -> Iterator[str]:
    """A whole SPARQL JSON results document, piece by piece: head, bindings in the order of the rows, end."""
    yield json.dumps({"head": {"vars": names}})[:-1] + ', "results": {"bindings": ['
    for n, row in enumerate(results_json(df, names).toLocalIterator(prefetchPartitions=True)):
        yield ("," if n else "") + row[0]
    yield "]}}"


def boolean_document(answer: bool) -> str:
    return json.dumps({"head": {}, "boolean": answer})


def results_csv(df: DataFrame, names: list[str], path: str) -> None:
    df.select(*[terms.lexical(F.col(f"`{n}`")).alias(n) for n in names]).write.mode("overwrite").csv(path, header=True)
