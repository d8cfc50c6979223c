"""What the fields of a query mean in a DataFrame of event documents.

A field is a column: one value per document, an array of values, or an array of structs (value, ctx) where
ctx is the grouping context that links values of several fields. Its type says how values and literals are
normalised before they are compared.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.lang.dates import column_millis, millis, parse_date
from siltstone.lang.jexl import QueryError

TEXT, EXACT, NUMBER, DATE, IP = "text", "exact", "number", "date", "ip"


def pad_ipv4(value: Column) -> Column:
    """Octets filled up to three digits; wildcards stay."""
    octets = F.split(value, r"\.")
    return F.array_join(F.transform(octets, lambda o: F.when(o.contains("*"), o).otherwise(F.lpad(o, 3, "0"))), ".")


def text_bounds(value: str) -> tuple[str, str] | None:
    """Least and greatest text that equals an ASCII text in any case, None for other texts.

    Capitals sort before small letters at every place; beyond ASCII only the Kelvin sign becomes a letter of it.
    """
    return (value.upper(), value.lower().replace("k", "\u212a")) if value and value.isascii() else None


@dataclass(frozen=True)
class Field:
    name: str
    column: str
    type: str = TEXT
    spark: str = "string"  # Spark type of one value
    multi: bool = False
    context: bool = False
    tokenized: bool = False

    def raw(self, element: Column) -> Column:
        return (element["value"] if self.context else element).cast("string") if self.spark != "string" else element["value"] if self.context else element

    def value(self, element: Column) -> Column:
        return element["value"] if self.context else element

    def norm(self, element: Column) -> Column:
        v = self.value(element)
        if self.type == TEXT:
            return F.lower(v)
        if self.type == NUMBER:
            return v if self.spark in ("double", "bigint", "int", "float") else v.try_cast("double")
        if self.type == DATE:
            return column_millis(v, self.spark)
        if self.type == IP:
            return pad_ipv4(v)
        return v

    def literal(self, value: object) -> Column:
        """A literal in the field's normal form; raises :class:`QueryError` if it has none."""
        if self.type == NUMBER:
            try:
                number = value if isinstance(value, (int, float)) and not isinstance(value, bool) else float(str(value))
            except ValueError as e:
                raise QueryError(f"{self.name}: not a number: {value!r}") from e
            return F.lit(int(number) if self.spark in ("bigint", "int") and float(number).is_integer() else float(number))
        if self.type == DATE:
            return F.lit(value) if isinstance(value, int) and self.spark in ("bigint", "int") else F.lit(millis(parse_date(str(value))[0]))
        if self.type == IP:
            return F.lit(".".join(o if "*" in o else o.zfill(3) for o in str(value).split(".")))
        return F.lit(str(value).lower() if self.type == TEXT else str(value))


@dataclass
class Catalog:
    """Fields by upper-case name, and the query model: names that stand for other fields."""

    fields: dict[str, Field]
    model: dict[str, list[str]] = field(default_factory=dict)
    indexed: set[str] = field(default_factory=set)
    analysed: dict[str, str] = field(default_factory=dict)  # fields of analysed tokens and their columns

    @classmethod
    def of(cls, df: DataFrame, types: dict[str, str] | None = None, model: dict[str, list[str]] | None = None, tokenized: set[str] = frozenset()) -> Catalog:  # type: ignore[assignment]
        """Fields of a DataFrame: every column by its name; ``types`` overrides what follows from Spark's types."""
        out = {}
        for f in df.schema.fields:
            kind, multi, context = f.dataType, False, False
            if isinstance(kind, T.ArrayType):
                kind, multi = kind.elementType, True
                if isinstance(kind, T.StructType) and "value" in kind.names:
                    kind, context = kind["value"].dataType, True
            if isinstance(kind, (T.MapType, T.StructType, T.ArrayType, T.BinaryType)):
                continue
            name, spark = f.name.upper(), kind.simpleString()
            default = NUMBER if isinstance(kind, T.NumericType) else DATE if spark.startswith("timestamp") or spark == "date" else TEXT
            out[name] = Field(name, f.name, (types or {}).get(name, default), spark, multi, context, name in tokenized)
        return cls(out, {k.upper(): [x.upper() for x in v] for k, v in (model or {}).items()})

    def lookup(self, name: str, expand: bool = True) -> list[Field]:
        """Fields that a name stands for; none for an unknown name."""
        name = name.upper()
        if name == "_ANYFIELD_":
            return list(self.fields.values())
        names = [name, *self.model.get(name, [])] if expand else [name]
        return [self.fields[n] for n in dict.fromkeys(names) if n in self.fields]

    def typed(self, **types: str) -> Catalog:
        return replace(self, fields=self.fields | {n: replace(self.fields[n], type=t) for n, t in types.items()})
