"""The label service as joins: one left join for each variable that wants a label, description or alias."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import terms as T
from ..plans import algebra as L
from ..plans.relation import Rel, V, column_name
from . import joins

#: Suffixes of implicit targets, in the order in which they are tried.
SUFFIXES = (("AltLabel", "alias"), ("Label", "label"), ("Description", "description"))


def targets(node: L.Labels, projected: list[str], child: Rel) -> list[tuple[str, str, str]]:
    """(variable, label | description | alias, target)."""
    if node.explicit:
        return [(v, T.LABEL_IRIS[iri], t) for v, iri, t in node.explicit if iri in T.LABEL_IRIS]
    out = []
    for name in projected:
        for suffix, what in SUFFIXES:
            if name.endswith(suffix) and name[: -len(suffix)] in child.vars:
                out.append((name[: -len(suffix)], what, name))
                break
    return out


def attach(source, child: Rel, node: L.Labels, projected: list[str]) -> Rel:
    """child with the targets bound: the first of the languages that has a value; of aliases all of that language, joined by commas."""
    if not node.languages:
        return child
    for variable, what, target in targets(node, projected, child):
        if variable not in child.vars or target in child.vars:
            continue
        found = source.labels(what, node.languages, child.vars[variable].classes)  # (.s, .lang, .value)
        # An array of languages in their order of preference.
        rank = F.array_position(F.array(*(F.lit(x) for x in node.languages)), found.col(".lang"))
        key, value = found.col(".s"), found.col(".value")
        best = found.df.select(key.alias("s"), rank.alias("rank"), value.alias("value"))
        if what == "alias" or not (source.one_label_each and len(node.languages) == 1):
            # Only what the child asks for is aggregated, not all labels there are.
            own = child.vars[variable].kind
            asked = child.col(variable) if own == found.vars[".s"].kind else T.to_term(child.col(variable), own)
            wanted = child.df.select(asked.alias("want")).where("want is not null").distinct()
            best = best.join(wanted, (best["s"] if own == found.vars[".s"].kind or found.vars[".s"].kind == "term" else T.to_term(best["s"], found.vars[".s"].kind)) == wanted["want"], "left_semi")
        if what == "alias":
            best = best.groupBy("s", "rank").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("value"))
        if not (source.one_label_each and len(node.languages) == 1 and what != "alias"):
            best = best.groupBy("s").agg(F.min(F.struct("rank", "value"))["value"].alias("value"))
        right = Rel(best.select(F.col("s").alias(column_name(variable)), F.col("value").alias(column_name(target))), {variable: V(found.vars[".s"].kind), target: V("string")})
        child = joins.left_join(child, right) if child.vars[variable].kind == right.vars[variable].kind or "term" in (child.vars[variable].kind, right.vars[variable].kind) else Rel(child.df.withColumn(column_name(target), F.lit(None).cast("string")), child.vars | {target: V("string", True)})
    return child


def call(source, child: Rel, variable: str, languages: list[str], target: str) -> Rel:
    """child with target bound to the label of variable in the first of the languages that has one."""
    return attach(source, child, L.Labels(None, languages, [(variable, T.PREFIXES["rdfs"] + "label", target)]), [])
