"""Plan to DataFrame.  Pure: nothing here runs a job."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame

from joinloom.functions.keys import in_cells, semi_reduced
from joinloom.operators.join import inner_equi_join
from joinloom.operators.scan import renamed, scan
from joinloom.plans.late import LateStrings
from joinloom.plans.plan import JoinNode, Plan, ScanNode
from joinloom.plans.strategy import POLICIES, hinted
from joinloom.types import DataType, PlanError

BROADCAST_BYTES = 10 << 20


def compile_plan(
    plan: Plan,
    *,
    build: str = "auto",
    strings: str = "early",
    names: Sequence[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    semi: bool = False,
    shared: str = "recompute",
) -> DataFrame:
    """The plan's result as a lazy DataFrame.

    build: see ``strategy``; a spread join sorts, as its copied rows are not what estimates say.  strings: ``early`` carries payload strings through
    every join, ``late`` carries row references and joins the strings back once
    at the root (only for tables with a declared primary key).  names: of the
    root's columns, unique; ``c0``, ``c1``, ... if not given.  NULL keys and NaN
    keys match nothing; rows are a bag.  semi: probe sides are reduced to rows that have
    a partner before they are joined.  shared: a join with several parents is compiled
    once; ``recompute`` leaves it to Catalyst whether it runs once (the logical plan is a
    tree, so a ladder of n self-joins has 2^n leaves), ``checkpoint`` runs it at once and
    writes its rows to the checkpoint folder, which must be set.
    """
    plan.validate()
    if build not in POLICIES:
        raise PlanError(f"build must be one of {POLICIES}")
    if strings not in ("early", "late"):
        raise PlanError("strings must be 'early' or 'late'")
    width = len(plan.nodes[plan.root].output_attrs)
    names = list(names) if names is not None else [f"c{i}" for i in range(width)]
    if len(names) != width or len({n.lower() for n in names}) != width:
        raise PlanError(f"{width} unique names are needed for the root's columns")
    if shared not in ("recompute", "checkpoint"):
        raise PlanError("shared must be 'recompute' or 'checkpoint'")
    late = LateStrings(plan) if strings == "late" else None
    instances = iter(range(1 << 62))
    nodes = plan.order()
    parents = Counter(c for i in nodes if isinstance(d := plan.nodes[i].data, JoinNode) for c in (d.left, d.right))
    #: Each node's DataFrame, and its outputs: a column name, or a late reference.
    made: dict[int, tuple[DataFrame, list]] = {}

    def used(idx: int) -> tuple[DataFrame, list]:
        """The node's, under names of their own if it has several parents."""
        return made[idx] if parents[idx] < 2 else renamed(*made[idx], next(instances))

    for idx in nodes:
        node, uid = plan.nodes[idx], next(instances)
        if isinstance(node.data, ScanNode):
            table = plan.inputs[node.data.base_table_id]
            made[idx] = scan(table, node.output_attrs, late.deferred(idx) if late else set(), uid)
            continue
        join = node.data
        (ldf, lout), (rdf, rout) = used(join.left), used(join.right)
        lkey, rkey = lout[join.left_attr], rout[join.right_attr]
        if semi and join.build_left:
            rdf = semi_reduced(rdf, rkey, ldf, lkey)
        elif semi:
            ldf = semi_reduced(ldf, lkey, rdf, rkey)
        cells = []
        if join.spread:
            ldf, rdf, cells = in_cells(ldf, rdf, lkey, rkey, uid)
        ldf, rdf = hinted(ldf, rdf, join.build_left, "sort_merge" if join.spread else build, broadcast_bytes)
        made[idx] = inner_equi_join(
            ldf, rdf, lkey, rkey, lout + rout, [i for i, _ in node.output_attrs], uid,
            nan_free=plan.types(join.left)[join.left_attr] is DataType.FP64, cells=cells,
        )
        if shared == "checkpoint" and parents[idx] > 1:
            made[idx] = made[idx][0].checkpoint(), made[idx][1]

    df, outs = made[plan.root]
    if late:
        df, outs = late.resolve(df, outs)
    return df.select(*[df[c].alias(n) for c, n in zip(outs, names, strict=True)])


def execute(plan: Plan, **options) -> DataFrame:
    """``compile_plan`` under the name a plan runner looks for; runs on the first action."""
    return compile_plan(plan, **options)
