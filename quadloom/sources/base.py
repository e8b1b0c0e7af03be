"""What the compiler asks of a source of facts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .. import terms as T
from ..plans import algebra as L
from ..plans.relation import Rel


@dataclass
class Part:
    """One leaf of a basic graph pattern: its number of constants, and how to read it."""

    constants: int
    rel: Callable[[], Rel]


class Source:
    """A graph of statements."""

    spark: SparkSession
    #: Whether a subject has at most one label or description a language.
    one_label_each = False

    def stars(self, triples: list[L.Triple]) -> list[Part]:
        """The triples of a pattern, put together to as few leaves as the source can."""
        raise NotImplementedError

    def edges(self, iri: str) -> Rel:
        """Pairs .s, .o of a predicate."""
        return self.stars([L.Triple(L.Var(".s"), L.Link(iri), L.Var(".o"))])[0].rel()

    def edges_except(self, iris: tuple[str, ...], subject: T.Const | None = None) -> Rel:
        """Pairs .s, .o of all other direct predicates, with a subject given at least all pairs of it."""
        raise NotImplementedError

    def nodes(self) -> Rel:
        """All subjects and objects, once each, as .s."""
        raise NotImplementedError

    def labels(self, what: str, languages: list[str], classes: frozenset[int] | None = None) -> Rel:
        """.s, .lang, .value of the labels, descriptions or aliases in these languages, of subjects of these classes where a source knows them."""
        raise NotImplementedError


def predicate(iri: str) -> tuple[str, object]:
    """(view, number or name): direct, statement, value, qualifier, label, or unknown."""
    if iri in T.LABEL_IRIS:
        return "label", T.LABEL_IRIS[iri]
    for view, start in (("direct", T.PREFIXES["wdt"]), ("value", T.PREFIXES["ps"]), ("qualifier", T.PREFIXES["pq"]), ("statement", T.PREFIXES["p"])):
        rest = iri.removeprefix(start)
        if rest != iri and rest[:1] == "P" and rest[1:].isdigit():
            return view, int(rest[1:])
    return "unknown", iri
