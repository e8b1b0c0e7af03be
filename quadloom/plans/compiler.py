"""From the algebra to DataFrames.

Nothing runs here (property path closures apart): each node becomes declarative
DataFrame operations, and Catalyst picks joins, pushes filters and prunes columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T
from ..functions.expressions import E, Scope, ebv, order_keys
from ..operators import joins, labels, paths
from ..operators.aggregates import group
from . import algebra as L
from .relation import Rel, V, column_name, empty, spark_type, unit


LABEL = T.PREFIXES["wikibase"] + "label"


class Compiler:
    def __init__(self, source):
        self.source = source
        self.spark = source.spark
        self.projected: list[str] = []
        self.marks = 0
        self.outer: Rel | None = None  # of the pattern of an EXISTS, the solutions that it is tested for

    def compile(self, node: object) -> Rel:
        return getattr(self, "_" + type(node).__name__.lower())(node)

    # ---- leaves

    def _unit(self, node: L.Unit) -> Rel:
        return unit(self.spark)

    def _values(self, node: L.Values) -> Rel:
        kinds = {}
        for k, name in enumerate(node.names):
            found = {r[k].kind for r in node.rows if r[k] is not None}
            kinds[name] = V("null" if not found else found.pop() if len(found) == 1 else "term", any(r[k] is None for r in node.rows))
        if not node.rows:
            return empty(self.spark, kinds)

        def cell(c: T.Const | None, kind: str) -> Column:
            if c is None:
                return F.lit(None).cast(spark_type(kind))
            return T.to_term(T.literal(c), c.kind) if kind == "term" else T.literal(c)

        rows = F.array(*(F.struct(*(cell(c, kinds[n].kind).alias(column_name(n)) for n, c in zip(node.names, r, strict=True))) for r in node.rows))
        return Rel(self.spark.range(1).select(F.explode(rows).alias("r")).select("r.*"), kinds)

    def _bgp(self, node: L.Bgp) -> Rel:
        """Stars first, then joins: most constants first, always next to what is bound, cross joins last."""
        parts = self.source.stars([t for t in node.triples if isinstance(t.p, (L.Var, L.Link))])
        rels = [(p.constants, p.rel()) for p in parts]
        free = []
        for t in node.triples:
            if not isinstance(t.p, (L.Var, L.Link)):
                constants = isinstance(t.s, T.Const) + isinstance(t.o, T.Const)
                if isinstance(t.p, L.Repeat) and t.p.many and not constants:
                    free.append(t)
                else:
                    rels.append((constants, self._path(t)))
        rels.sort(key=lambda x: -x[0])
        out = rels.pop(0)[1] if rels else None
        while rels:
            k = next((k for k, (_, r) in enumerate(rels) if set(r.vars) & set(out.vars)), 0)
            out = joins.join(out, rels.pop(k)[1])
        while free:
            # Closures with free ends come last and only start from what is bound by then.
            k = next((k for k, t in enumerate(free) if out is not None and {t.s.name, t.o.name} & set(out.vars)), 0)
            rel = self._path(free.pop(k), out)
            out = rel if out is None else joins.join(out, rel)
        return out if out is not None else unit(self.spark)

    def _path(self, t: L.Triple, bound: Rel | None = None) -> Rel:
        start, end = (x if isinstance(x, T.Const) else None for x in (t.s, t.o))
        seed = lambda x: bound.select({paths.S: (bound.col(x.name), bound.vars[x.name])}) if bound and isinstance(x, L.Var) and x.name in bound.vars else None
        if bound and (first := seed(t.s)):
            pairs = paths.closure(self.source, t.p, seeds=first)
        elif bound and (last := seed(t.o)):
            pairs = paths.swap(paths.closure(self.source, L.Repeat(L.Inverse(t.p.path), t.p.low, t.p.many), seeds=last))
        else:
            pairs = paths.evaluate(self.source, t.p, start, end)
        out = {}
        for place, x in ((paths.S, t.s), (paths.O, t.o)):
            col, v = pairs.col(place), pairs.vars[place]
            if isinstance(x, T.Const):
                test = col == T.to_term(T.literal(x), x.kind) if v.kind == "term" else (col == T.literal(x) if v.kind == x.kind else F.lit(False))
                pairs = pairs.where(test)
            elif x.name in out:
                a, b = T.to_term(*_pair(out[x.name])), T.to_term(col, v.kind)
                pairs = pairs.where(out[x.name][0] == col if out[x.name][1].kind == v.kind else a == b)
            else:
                out[x.name] = (col, v)
        return pairs.select(out) if out else Rel(pairs.df.select(), {})

    # ---- joins and sets

    def _join(self, node: L.Join) -> Rel:
        return joins.join_all([self.compile(n) for n in _joined(node)])

    def _leftjoin(self, node: L.LeftJoin) -> Rel:
        left, right = self.compile(node.left), self.compile(node.right)
        if node.condition is None:
            return joins.left_join(left, right)
        left = self._with_outer(left, node.condition, right)
        if _contains_exists(node.condition):
            # Pairs that pass, and the left rows that are in none of them.
            if any(n in right.vars and v.nullable for n, v in left.vars.items()):
                raise T.SparqlError("an EXISTS in the filter of an OPTIONAL needs shared variables that are bound")
            pairs = self._filtered(joins.join(left, right), node.condition)
            met = pairs.df.select(*(pairs.col(n).alias("m@" + column_name(n)) for n in left.vars))
            same = [left.col(n).eqNullSafe(F.col(f"`m@{column_name(n)}`")) for n in left.vars]
            return joins.union(pairs, Rel(left.df.join(met, same or F.lit(True), "left_anti"), dict(left.vars)))
        return joins.left_join(left, right, lambda both: self._condition(node.condition, both))

    def _condition(self, condition: object, both: dict[str, tuple[Column, str]]) -> Column:
        return ebv(Scope(lambda n: E(*both[n]) if n in both else E(F.lit(None), "null")).compile(condition))

    def _union(self, node: L.Union) -> Rel:
        return joins.union(self.compile(node.left), self.compile(node.right))

    def _minus(self, node: L.Minus) -> Rel:
        return joins.minus(self.compile(node.left), self.compile(node.right))

    # ---- filters

    def _filter(self, node: L.Filter) -> Rel:
        return self._filtered(self.compile(node.child), node.condition)

    def _filtered(self, child: Rel, filters: object) -> Rel:
        for condition in _conjuncts(filters):
            child = self._with_outer(child, condition)
            if isinstance(condition, L.Call) and condition.name == "!" and isinstance(condition.args[0], L.Exists):
                condition = L.Exists(condition.args[0].pattern, not condition.args[0].negated)
            if isinstance(condition, L.Exists):
                right, test = self._inner(condition.pattern, child)
                child = joins.semi_join(child, right, condition.negated, test)
            else:
                child, scope, extra = self._scope(child, condition)
                child = child.where(ebv(scope.compile(condition)))
                child = Rel(child.df.drop(*extra), child.vars)
        return child

    def _with_outer(self, child: Rel, condition: object, other: Rel | None = None) -> Rel:
        """child joined with those variables around an EXISTS that a filter in its pattern needs."""
        if self.outer is None:
            return child
        have = set(child.vars) | set(other.vars if other else ())
        need = sorted(n for n in L.variables(condition) if n in self.outer.vars and n not in have)
        if not need:
            return child
        keys = self.outer.keep([n for n in self.outer.vars if n in need or n in have])
        return joins.join(child, Rel(keys.df.distinct(), keys.vars))

    def _inner(self, pattern: object, outer: Rel):
        """The pattern of an EXISTS, and a test for those of its filters that need the outer row."""
        late = []
        while isinstance(pattern, L.Filter):
            late.append(pattern.condition)
            pattern = pattern.child
        held, self.outer = self.outer, outer
        right = self.compile(pattern)
        self.outer = held
        inner = [c for c in late if not any(n not in right.vars and n in outer.vars for n in L.variables(c))]
        for c in inner:
            right, scope, extra = self._scope(right, c)
            right = right.where(ebv(scope.compile(c)))
            right = Rel(right.df.drop(*extra), right.vars)
        rest = [c for c in late if c not in inner]
        if not rest:
            return right, None

        def test(both):
            out = F.lit(True)
            for c in rest:
                out = out & self._condition(c, both)
            return out

        return right, test

    def _scope(self, child: Rel, *expressions: object) -> tuple[Rel, Scope, list[str]]:
        """A scope for expressions over child; each EXISTS and label call inside them becomes a column by a left join."""
        marks: dict[int, str] = {}  # by the identity of the node

        def visit(e: object) -> None:
            nonlocal child
            if isinstance(e, L.Exists):
                if id(e) in marks:
                    return
                right, test = self._inner(e.pattern, child)
                shared = [n for n in right.vars if n in child.vars]
                self.marks += 1
                name = f".e{self.marks}"
                if test is not None or any(child.vars[n].nullable or right.vars[n].nullable for n in shared):
                    # Filters on the outer row, or unbound variables that could meet several rows: those with and those without.
                    both = [joins.semi_join(child, right, negated, test) for negated in (False, True)]
                    child = joins.union(*(Rel(r.df.withColumn(column_name(name), F.lit(not k)), r.vars | {name: V("bool")}) for k, r in enumerate(both)))
                    marks[id(e)] = name
                    return
                keys = right.keep(shared)
                keys = Rel(keys.df.distinct().withColumn(column_name(name), F.lit(True)), keys.vars | {name: V("bool")}) if shared else Rel(keys.df.limit(1).withColumn(column_name(name), F.lit(True)), {name: V("bool")})
                child = joins.left_join(child, keys)
                marks[id(e)] = name
            elif isinstance(e, L.Call) and e.name == LABEL:
                if id(e) in marks:
                    return
                if not e.args or not all(isinstance(a, T.Const) for a in e.args[1:]):
                    raise T.SparqlError("wikibase:label needs an expression and constant languages")
                self.marks += 1
                name, at = f".l{self.marks}", f".x{self.marks}"
                subject = Scope(child.lookup).compile(e.args[0])
                child = Rel(child.df.withColumn(column_name(at), subject.col if subject.kind != "null" else F.lit(None).cast("string")), child.vars | {at: V(subject.kind if subject.kind != "null" else "string", True)})
                child = labels.call(self.source, child, at, [str(a.value) for a in e.args[1:]] or ["en"], name)
                if name not in child.vars:
                    child = Rel(child.df.withColumn(column_name(name), F.lit(None).cast("string")), child.vars | {name: V("string", True)})
                child = Rel(child.df.drop(column_name(at)), {n: v for n, v in child.vars.items() if n != at})
                marks[id(e)] = name
            elif isinstance(e, (L.Call, L.Aggregate)):
                for a in e.args if isinstance(e, L.Call) else (e.arg,):
                    visit(a)

        for e in expressions:
            visit(e)
        child = Rel(child.df, {n: v for n, v in child.vars.items() if n not in marks.values()})

        def flag(e: L.Exists) -> Column:
            found = F.coalesce(child.col(marks[id(e)]), F.lit(False))
            return ~found if e.negated else found

        def joined(e: L.Call) -> E | None:
            return E(child.col(marks[id(e)]), "string") if id(e) in marks else None

        return child, Scope(child.lookup, flag, joined), [column_name(n) for n in marks.values()]

    def _extend(self, node: L.Extend) -> Rel:
        child = self.compile(node.child)
        if node.name in child.vars:
            raise T.SparqlError(f"?{node.name} is already bound")
        child, scope, extra = self._scope(child, node.expression)
        e = scope.compile(node.expression)
        inner = child.vars.get(node.expression.name) if isinstance(node.expression, L.Var) else None
        firm = isinstance(node.expression, T.Const) and e.kind != "null" or bool(inner and not inner.nullable)
        col = e.col if e.kind != "null" else F.lit(None).cast("string")
        return Rel(child.df.withColumn(column_name(node.name), col).drop(*extra), child.vars | {node.name: V(e.kind if e.kind != "null" else "string", not firm)})

    # ---- modifiers

    def _group(self, node: L.Group) -> Rel:
        child = self.compile(node.child)
        child, scope, _ = self._scope(child, *(e for _, e in node.keys), *(a for _, a in node.aggregates))
        return group(child, node, scope)

    def _labels(self, node: L.Labels) -> Rel:
        return labels.attach(self.source, self.compile(node.child), node, self.projected)

    def _project(self, node: L.Project) -> Rel:
        outer, self.projected = self.projected, sorted(L.variables(node))
        child = self.compile(node.child)
        self.projected = outer
        names = [n for n in child.vars if not n.startswith(".")] if node.names is None else list(dict.fromkeys(node.names))
        return child.select({n: (child.col(n), child.vars[n]) if n in child.vars else (F.lit(None).cast("string"), V("string", True)) for n in names})

    def _distinct(self, node: L.Distinct) -> Rel:
        child = self.compile(node.child)
        return Rel(child.df.distinct(), child.vars)

    def _reduced(self, node: L.Reduced) -> Rel:
        return self.compile(node.child)

    def _orderby(self, node: L.OrderBy) -> Rel:
        child = self.compile(node.child)
        child, scope, extra = self._scope(child, *(e for e, _ in node.keys))
        keys = [k for e, descending in node.keys for k in order_keys(scope.compile(e), descending)]
        return Rel(child.df.orderBy(*keys).drop(*extra) if keys else child.df, child.vars)

    def _slice(self, node: L.Slice) -> Rel:
        child = self.compile(node.child)
        df = child.df.offset(node.offset) if node.offset else child.df
        return Rel(df.limit(node.limit) if node.limit is not None else df, child.vars)


def _pair(x: tuple[Column, V]) -> tuple[Column, str]:
    return x[0], x[1].kind


def _joined(node: object) -> list[object]:
    return _joined(node.left) + _joined(node.right) if isinstance(node, L.Join) else [node]


def _contains_exists(e: object) -> bool:
    return isinstance(e, L.Exists) or isinstance(e, L.Call) and any(map(_contains_exists, e.args))


def _conjuncts(e: object) -> list[object]:
    if isinstance(e, L.Call) and e.name == "&&":
        return _conjuncts(e.args[0]) + _conjuncts(e.args[1])
    return [e]
