"""Results in the SPARQL 1.1 JSON format."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms as T
from .plans.relation import Rel


def cell(col: Column, kind: str) -> Column:
    """type, value, xml:lang and datatype of a term; null if unbound."""
    iri = T.is_iri(col, kind) | (F.lit(kind == "iri") if kind != "term" else F.lit(False))
    lang = F.nullif(T.lang(col, kind), F.lit(""))
    named = T.datatype(col, kind)
    plain = named.isin(T.XSD + "string", T.RDF_LANG)
    return F.when(col.isNotNull(), F.struct(F.when(iri, "uri").otherwise("literal").alias("type"), T.lexical(col, kind).alias("value"), F.when(~iri, lang).alias("xml:lang"), F.when(~iri & ~plain, named).alias("datatype")))


def bindings(rel: Rel) -> DataFrame:
    """One JSON object a solution (column json), without unbound variables."""
    if not rel.vars:
        return rel.df.select(F.lit("{}").alias("json"))
    return rel.df.select(F.to_json(F.struct(*(cell(rel.col(n), v.kind).alias(n) for n, v in rel.vars.items()))).alias("json"))


def pieces(rel: Rel) -> Iterator[str]:
    """The result document in pieces, so that a large one never lies on the driver as a whole."""
    yield json.dumps({"head": {"vars": list(rel.vars)}})[:-1] + ', "results": {"bindings": ['
    for k, row in enumerate(bindings(rel).toLocalIterator(prefetchPartitions=True)):
        yield (", " if k else "") + row["json"]
    yield "]}}"


def ask_document(answer: bool) -> str:
    return json.dumps({"head": {}, "boolean": answer})
