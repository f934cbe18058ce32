"""Collections: their fields, keys, relations and computed fields, and the table behind each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CollectionNotFound, ValidationError
from ..functions.computed import Computed
from ..functions.scalar import Scope
from ..operators.predicates import Sid

_TYPES: dict[str, T.DataType] = {
    **dict.fromkeys(("String", "ID", "Uuid", "Email", "URL", "PhoneNumber", "Time", "JSON", "Any", "Object"), T.StringType()),
    "Int": T.LongType(), "Float": T.DoubleType(), "Boolean": T.BooleanType(), "DateTime": T.TimestampType(), "Date": T.DateType(),
}
_FORMATS = {"Email": "email", "URL": "url", "Uuid": "uuid"}
#: The key of a collection that declares none: made for each row.
SYSTEM_KEY = "_sid"


def spark_type(name: str) -> T.DataType:
    """The Spark type of a declared one; dynamic values are JSON text."""
    if name.startswith("["):
        return T.ArrayType(spark_type(name[1:-1].rstrip("!")))
    return _TYPES.get(name, T.StringType())


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"[{type_name(kind.elementType)}]"
    for name in ("String", "Int", "Float", "Boolean", "DateTime", "Date"):
        if isinstance(kind, type(_TYPES[name])):
            return name
    if isinstance(kind, T.TimestampNTZType):
        return "DateTime"
    return "Int" if isinstance(kind, T.IntegralType) else "Float" if isinstance(kind, T.FractionalType) else "Object"


@dataclass
class FieldInfo:
    name: str
    type: str
    required: bool = False
    unique: bool = False
    indexed: bool = False
    relation: tuple[str, str] | None = None
    validations: dict[str, Any] = field(default_factory=dict)

    @property
    def rules(self) -> dict[str, Any]:
        return ({"format": _FORMATS[self.type]} if self.type in _FORMATS else {}) | self.validations


@dataclass
class Collection:
    name: str
    fields: dict[str, FieldInfo]
    #: What the system id is made of.
    keys: list[str]
    load: Callable[[], DataFrame]
    computed: dict[str, Computed] = field(default_factory=dict)

    def frame(self) -> DataFrame:
        """The table with its computed fields."""
        df = self.load()
        return df.withColumns({n: f(df.schema) for n, f in self.computed.items()}) if self.computed else df

    def sid(self, schema: T.StructType) -> Sid:
        return Sid([schema[k] for k in self.keys])

    def scope(self, schema: T.StructType) -> Scope:
        return Scope(schema)

    @property
    def own_sid(self) -> bool:
        return self.keys == [SYSTEM_KEY]


class Catalog:
    def __init__(self) -> None:
        self.collections: dict[str, Collection] = {}

    def __contains__(self, name: str) -> bool:
        return name in self.collections

    def get(self, name: str) -> Collection:
        if name not in self.collections:
            raise CollectionNotFound(f"no collection {name}")
        return self.collections[name]

    def register(self, name: str, table: DataFrame | Callable[[], DataFrame], keys: list[str] | str, *, relations: dict[str, tuple[str, str]] | None = None, computed: dict[str, Computed] | None = None, unique: tuple[str, ...] = (), validations: dict[str, dict[str, Any]] | None = None) -> Collection:
        """Makes a collection of a table.  keys must tell its rows apart."""
        load = table if callable(table) and not isinstance(table, DataFrame) else lambda: table
        keys = [keys] if isinstance(keys, str) else list(keys)
        schema = load().schema
        if missing := [k for k in keys if k not in schema.names]:
            raise ValidationError(f"{name} has no {missing[0]}")
        fields = {f.name: FieldInfo(f.name, type_name(f.dataType), not f.nullable, f.name in unique or [f.name] == keys, f.name in keys, (relations or {}).get(f.name), (validations or {}).get(f.name, {})) for f in schema}
        self.collections[name] = Collection(name, fields, keys, load, dict(computed or {}))
        return self.collections[name]

    def describe(self, spark: SparkSession) -> DataFrame:
        """A row for each field of each collection."""
        rows = [(c.name, f.name, f.type, f.required, f.indexed, f.unique, ", ".join(f"{k}={v}" for k, v in sorted(f.rules.items())), f"{f.relation[0]}.{f.relation[1]}" if f.relation else None) for c in self.collections.values() for f in c.fields.values()]
        return spark.createDataFrame(rows, "collection string, name string, type string, required boolean, indexed boolean, unique boolean, validations string, relation string")

    def stats(self, spark: SparkSession, name: str) -> DataFrame:
        """Rows, bytes as JSON, and the mean of these, of one collection."""
        df = self.get(name).load()
        size = F.octet_length(F.to_json(F.struct("*"))).cast("long")
        return df.agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.avg(size).alias("mean_bytes"))
