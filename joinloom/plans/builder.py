"""Plans by column name: the positional model underneath, readable queries on top."""

from __future__ import annotations

from pyspark.sql import DataFrame

from joinloom.plans.compile import compile_plan
from joinloom.plans.plan import Plan
from joinloom.sources.catalog import Catalog


class Rel:
    """A node of a plan under construction, with names for its positions."""

    def __init__(self, builder: "Builder", idx: int, names: list[str]):
        self.builder, self.idx, self.names = builder, idx, names

    def join(self, other: "Rel", on: str, output: list[str] | None = None, build_left: bool = False, spread: bool = False) -> "Rel":
        """on: ``left = right``; names after the join are left's, then right's, and
        ``output`` picks from them (``name`` finds the first, ``#i`` position i).  build_left, spread: see ``JoinNode``."""
        left, right = (x.strip() for x in on.split("="))
        plan = self.builder.plan
        source = self.names + other.names
        types = plan.types(self.idx) + plan.types(other.idx)
        picked = range(len(source)) if output is None else [int(o[1:]) if o[0] == "#" else source.index(o) for o in output]
        idx = plan.add_join(self.idx, other.idx, self.names.index(left), other.names.index(right), [(i, types[i]) for i in picked], build_left, spread)
        return Rel(self.builder, idx, [source[i] for i in picked])

    def compile(self, names: list[str] | None = None, **options) -> DataFrame:
        plan = self.builder.plan
        plan.root, plan.inputs = self.idx, self.builder.catalog.inputs
        return compile_plan(plan, names=names or self.names, **options)


class Builder:
    def __init__(self, catalog: Catalog):
        self.catalog, self.plan = catalog, Plan()

    def scan(self, table: str, *columns: str) -> Rel:
        attrs = self.catalog.attrs(table, *columns)
        return Rel(self, self.plan.add_scan(self.catalog.add(table), attrs), list(columns))
