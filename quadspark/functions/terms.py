"""Terms: the values a variable can be bound to, as one struct column.

``kind`` is U node, S text, I integer, D double, B boolean, L text with a language, T any other typed
literal, X bytes, V vector. ``key`` is a canonical spelling: two terms are the same term exactly if
their keys are equal, so joins, groups and duplicates go by it. A null struct is an unbound variable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("str", T.StringType()),
        T.StructField("int", T.LongType()),
        T.StructField("dbl", T.DoubleType()),
        T.StructField("bool", T.BooleanType()),
        T.StructField("lang", T.StringType()),
        T.StructField("dt", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)
TERM_DDL = TERM.simpleString()

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
RDF_TYPE = RDF + "type"

#: The datatypes read as integers and as doubles; others stay typed literals.
INTEGER_TYPES = tuple(XSD + t for t in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger"))
DOUBLE_TYPES = tuple(XSD + t for t in ("double", "float", "decimal"))
#: Further integer types whose typed literals still compare as numbers.
NUMERIC_TYPES = INTEGER_TYPES + DOUBLE_TYPES + tuple(XSD + t for t in ("unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte", "negativeInteger", "nonPositiveInteger"))
TEMPORAL_TYPES = tuple(XSD + t for t in ("date", "dateTime", "time", "gYear", "gYearMonth", "duration", "dayTimeDuration", "yearMonthDuration"))


def _term(kind: str, key: Column, **fields: Column) -> Column:
    kinds = {"str": "string", "int": "bigint", "dbl": "double", "bool": "boolean", "lang": "string", "dt": "string"}
    parts = [F.lit(kind).alias("kind"), *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]]
    return F.struct(*parts, F.concat(F.lit(f"{kind}:"), key).alias("key"))


def _or_null(test: Column, term: Column) -> Column:
    return F.when(test.isNotNull(), term)


def node(iri: Column) -> Column:
    return _or_null(iri, _term("U", iri, str=iri))


def text(value: Column) -> Column:
    return _or_null(value, _term("S", value, str=value))


def integer(value: Column) -> Column:
    return _or_null(value, _term("I", value.cast("string"), int=value))


def double(value: Column) -> Column:
    # -0.0 and 0.0 are one term
    same = F.when(value == 0, F.lit(0.0)).otherwise(value.cast("double"))
    return _or_null(value, _term("D", same.cast("string"), dbl=same))


def boolean(value: Column) -> Column:
    return _or_null(value, _term("B", value.cast("string"), bool=value))


def lang_text(value: Column, lang: Column) -> Column:
    return _or_null(value, _term("L", F.concat(F.lower(lang), F.lit("|"), value), str=value, lang=lang))


def typed(value: Column, datatype: Column) -> Column:
    return _or_null(value, _term("T", F.concat(datatype, F.lit("|"), value), str=value, dt=datatype))


def blob(value: Column) -> Column:
    return _or_null(value, _term("X", F.hex(value), str=F.hex(value)))


def literal(lexical: Column, lang: Column, datatype: Column) -> Column:
    """The term of a literal as written: native where the datatype is and the form parses, else typed."""
    as_int, as_dbl = lexical.try_cast("bigint"), lexical.try_cast("double")
    whole = F.when(lexical.rlike(r"^[+-]?[0-9]+$"), as_int)
    true, false = lexical.isin("true", "1"), lexical.isin("false", "0")
    return (
        F.when(lang.isNotNull(), lang_text(lexical, lang))
        .when(datatype.isNull() | (datatype == XSD + "string"), text(lexical))
        .when(datatype.isin(*INTEGER_TYPES) & whole.isNotNull(), integer(whole))
        .when(datatype.isin(*DOUBLE_TYPES) & as_dbl.isNotNull(), double(as_dbl))
        .when((datatype == XSD + "boolean") & (true | false), boolean(true))
        .otherwise(typed(lexical, datatype))
    )


@dataclass(frozen=True)
class Value:
    """A constant term of a query."""

    kind: str
    value: object
    extra: str | None = None  # the language of L, the datatype of T

    @staticmethod
    def of(x: object) -> Value:
        if isinstance(x, Value):
            return x
        if isinstance(x, bool):
            return Value("B", x)
        return Value("I", x) if isinstance(x, int) else Value("D", x) if isinstance(x, float) else Value("S", x)

    def column(self) -> Column:
        v = F.lit(self.value)
        one = {"U": node, "S": text, "I": integer, "D": double, "B": boolean}
        return one[self.kind](v) if self.kind in one else (lang_text if self.kind == "L" else typed)(v, F.lit(self.extra))

    def key(self) -> Column:
        """The key; literals of the query fold to a constant, so it is pushed down to the scan."""
        plain = {"U", "S"}
        if self.kind in plain:
            return F.lit(f"{self.kind}:{self.value}")
        if self.kind == "I":
            return F.lit(f"I:{self.value}")
        if self.kind == "B":
            return F.lit(f"B:{str(self.value).lower()}")
        if self.kind == "L":
            return F.lit(f"L:{self.extra.lower()}|{self.value}")
        if self.kind == "T":
            return F.lit(f"T:{self.extra}|{self.value}")
        return self.column()["key"]


def parse_literal(lexical: str, lang: str | None = None, datatype: str | None = None) -> Value:
    """:func:`literal` for a constant."""
    if lang:
        return Value("L", lexical, lang)
    if datatype in (None, XSD + "string"):
        return Value("S", lexical)
    try:
        if datatype in INTEGER_TYPES and lexical.lstrip("+-").isdigit() and -(1 << 63) <= int(lexical) < 1 << 63:
            return Value("I", int(lexical))
        if datatype in DOUBLE_TYPES:
            return Value("D", float(lexical))
    except ValueError:
        pass
    if datatype == XSD + "boolean" and lexical in ("true", "false", "1", "0"):
        return Value("B", lexical in ("true", "1"))
    return Value("T", lexical, datatype)


# --- comparison; null is the error of three-valued logic ------------------------------------------

def number(t: Column) -> Column:
    """The numeric value of a term, null if it has none."""
    parsed = F.when((t["kind"] == "T") & t["dt"].isin(*NUMERIC_TYPES), t["str"].try_cast("double"))
    return F.coalesce(t["int"].cast("double"), t["dbl"], parsed)


def equal(a: Column, b: Column) -> Column:
    """Equality by value: across numbers; a node never equals a literal; incomparable terms are an error."""
    na, nb = number(a), number(b)
    same = a["key"] == b["key"]
    literal_kinds = (a["kind"] != "U") & (b["kind"] != "U")
    return (
        F.when(a["key"].isNull() | b["key"].isNull(), F.lit(None).cast("boolean"))
        .when((a["kind"] == "I") & (b["kind"] == "I"), a["int"] == b["int"])
        .when(na.isNotNull() & nb.isNotNull(), na == nb)
        .when(same, F.lit(True))
        .when(~literal_kinds, F.lit(False))
        .when((a["kind"] == b["kind"]) & a["kind"].isin("S", "L", "B"), F.lit(False))
        .when((a["kind"] == "T") & (b["kind"] == "T") & (a["dt"] == b["dt"]) & a["dt"].isin(*TEMPORAL_TYPES), F.lit(False))
        .when(a["kind"].isin("S", "L") & b["kind"].isin("S", "L"), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def less(a: Column, b: Column, or_equal: bool = False) -> Column:
    """Order by value: numbers, plain texts, booleans, temporal literals of one datatype; else an error."""
    op = (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y)
    na, nb = number(a), number(b)
    texts = (a["kind"] == "S") & (b["kind"] == "S")
    times = (a["kind"] == "T") & (b["kind"] == "T") & (a["dt"] == b["dt"]) & a["dt"].isin(*TEMPORAL_TYPES)
    return (
        F.when((a["kind"] == "I") & (b["kind"] == "I"), op(a["int"], b["int"]))
        .when(na.isNotNull() & nb.isNotNull(), op(na, nb))
        .when(texts | times, op(a["str"], b["str"]))
        .when((a["kind"] == "B") & (b["kind"] == "B"), op(a["bool"], b["bool"]))
    )


def order_key(t: Column) -> Column:
    """Sort key of the total order: unbound, nodes, numbers, booleans, plain, tagged, typed; then the key."""
    num = number(t)
    rank = (
        F.when(t["key"].isNull(), 0).when(t["kind"] == "U", 1).when(num.isNotNull(), 2).when(t["kind"] == "B", 3)
        .when(t["kind"] == "S", 4).when(t["kind"] == "L", 5).otherwise(6)
    )
    by_dt = F.when((rank == 6), t["dt"])
    return F.struct(rank.alias("rank"), num.alias("num"), F.when(t["kind"] == "B", t["bool"]).alias("bool"), by_dt.alias("dt"), F.when(rank != 2, t["str"]).alias("str"), F.lower(t["lang"]).alias("lang"), t["key"].alias("key"))


def lexical(t: Column) -> Column:
    """The term as text: an IRI, or a literal's lexical form."""
    return F.coalesce(t["str"], t["int"].cast("string"), t["dbl"].cast("string"), t["bool"].cast("string"))


def datatype(t: Column) -> Column:
    """The datatype IRI of a literal; an error for nodes."""
    return (
        F.when(t["kind"] == "S", XSD + "string").when(t["kind"] == "I", XSD + "integer").when(t["kind"] == "D", XSD + "double")
        .when(t["kind"] == "B", XSD + "boolean").when(t["kind"] == "L", RDF + "langString").when(t["kind"] == "T", t["dt"])
    )


def truth(t: Column) -> Column:
    """Effective boolean value; null for nodes and terms without one."""
    num = number(t)
    return F.when(t["kind"] == "B", t["bool"]).when(t["kind"].isin("S", "L"), F.length(t["str"]) > 0).when(num.isNotNull(), (num != 0) & ~F.isnan(num))


def plain(t: Column) -> Column:
    """A term for people and tests: lexical form, null if unbound."""
    return lexical(t)
