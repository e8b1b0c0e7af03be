"""The engine: queries in, DataFrames or JSON out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import results
from . import terms as T
from .plans.compiler import Compiler
from .plans.parser import parse
from .plans.relation import Rel
from .sources.base import Source


class Engine:
    def __init__(self, source: Source):
        self.source = source

    def relation(self, text: str) -> tuple[str, Rel]:
        """The form of the query (SELECT or ASK) and its solutions with their kinds."""
        query = parse(text)
        return query.form, Compiler(self.source).compile(query.plan)

    def sparql(self, text: str) -> DataFrame:
        """The solutions of a SELECT, one column for each variable: entities as numbers, strings without
        their language, terms of mixed kinds in their lexical form. An ASK gives one row with the column answer."""
        form, rel = self.relation(text)
        if form == "ASK":
            return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        names = {n: (rel.col(n)["s"] if v.kind == "text" else T.lexical(rel.col(n), "term") if v.kind == "term" else rel.col(n)) for n, v in rel.vars.items()}
        return rel.df.select(*(c.alias(n) for n, c in names.items()))

    def ask(self, text: str) -> bool:
        return not self.relation(text)[1].df.isEmpty()

    def json(self, text: str) -> Iterator[str]:
        """The SPARQL JSON document, in pieces."""
        form, rel = self.relation(text)
        if form == "ASK":
            yield results.ask_document(not rel.df.isEmpty())
        else:
            yield from results.pieces(rel)
