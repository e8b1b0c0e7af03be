"""Solutions: a DataFrame whose columns are variables, with their kinds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..functions.expressions import E


def column_name(variable: str) -> str:
    """Spark does not tell upper from lower case in names, queries do."""
    return "v_" + re.sub("[A-Z]", lambda m: "%" + m[0].lower(), variable.replace(".", "#"))


@dataclass(frozen=True)
class V:
    kind: str
    nullable: bool = False
    #: Of items, the classes that they can belong to, where a source knows them.
    classes: frozenset[int] | None = None
    #: Whether a source knows that many rows can have the same value.
    repeats: bool = False


@dataclass
class Rel:
    df: DataFrame
    vars: dict[str, V] = field(default_factory=dict)

    def col(self, name: str) -> Column:
        return F.col(f"`{column_name(name)}`")

    def lookup(self, name: str) -> E:
        if name not in self.vars:
            return E(F.lit(None), "null")
        return E(self.col(name), self.vars[name].kind)

    def select(self, columns: dict[str, tuple[Column, V]]) -> Rel:
        return Rel(self.df.select(*(c.alias(column_name(n)) for n, (c, _) in columns.items())), {n: v for n, (_, v) in columns.items()})

    def keep(self, names: list[str]) -> Rel:
        return self.select({n: (self.col(n), self.vars[n]) for n in names})

    def with_kind(self, name: str, kind: str) -> Rel:
        """One variable turned into another kind."""
        v = self.vars[name]
        if v.kind == kind:
            return self
        col = T.to_term(self.col(name), v.kind) if kind == "term" else self.col(name).cast("double" if kind == "num" else "string")
        return Rel(self.df.withColumn(column_name(name), col), self.vars | {name: V(kind, v.nullable)})

    def where(self, condition: Column) -> Rel:
        return Rel(self.df.where(condition), dict(self.vars))


SPARK_TYPE = {"item": "bigint", "prop": "bigint", "pstmt": "bigint", "lexeme": "bigint", "int": "bigint", "num": "double", "bool": "boolean", "time": "timestamp_ntz", "text": "struct<s:string,l:string>", "term": T.TERM, "null": "void", "interval": "interval day to second"}


def spark_type(kind: str) -> str:
    return SPARK_TYPE.get(kind, "string")


def unit(spark: SparkSession) -> Rel:
    return Rel(spark.range(1).select(), {})


def empty(spark: SparkSession, variables: dict[str, V]) -> Rel:
    schema = ", ".join(f"`{column_name(n)}` {spark_type(v.kind)}" for n, v in variables.items())
    return Rel(spark.createDataFrame([], schema) if variables else spark.range(0).select(), dict(variables))
