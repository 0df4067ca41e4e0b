"""Late string materialisation as a plan rewrite.

A VARCHAR column that no join uses as key is replaced, at its scan, by the
table's primary key; the joins carry that reference, and one join per scanned
table brings the strings back at the root.  Worth its extra join where strings
are wide and the joins shuffle or multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from joinloom.plans.plan import Plan, ScanNode
from joinloom.plans.refs import LateRef
from joinloom.types import DataType


class LateStrings:
    def __init__(self, plan: Plan):
        self.plan = plan
        self.keys: set[tuple[int, int]] = set()
        for node in plan.nodes:
            if not isinstance(node.data, ScanNode):
                self._trace(node.data.left, node.data.left_attr)
                self._trace(node.data.right, node.data.right_attr)

    def _trace(self, idx: int, pos: int) -> None:
        """Marks the scan output that a key column comes from."""
        node = self.plan.nodes[idx]
        if isinstance(node.data, ScanNode):
            self.keys.add((idx, pos))
            return
        attr = node.output_attrs[pos][0]
        split = len(self.plan.nodes[node.data.left].output_attrs)
        self._trace(node.data.left if attr < split else node.data.right, attr if attr < split else attr - split)

    def deferred(self, idx: int) -> set[int]:
        """Output positions of a scan that are carried as references."""
        node = self.plan.nodes[idx]
        if self.plan.inputs[node.data.base_table_id].primary_key is None:
            return set()
        return {p for p, (_, t) in enumerate(node.output_attrs) if t is DataType.VARCHAR and (idx, p) not in self.keys}

    @staticmethod
    def resolve(df: DataFrame, outs: list) -> tuple[DataFrame, list[str]]:
        by_ref: dict[str, list[LateRef]] = {}
        for o in outs:
            if isinstance(o, LateRef):
                by_ref.setdefault(o.ref, []).append(o)
        found: dict[LateRef, str] = {}
        for ref, wanted in by_ref.items():
            base = wanted[0].table.df
            fields = base.columns
            pk = f"{ref}_pk"
            columns = sorted({w.column for w in wanted})
            side = base.select(base[fields[wanted[0].table.primary_key]].alias(pk), *[base[fields[c]].alias(f"{ref}_s{c}") for c in columns])
            df = df.join(side, df[ref] == side[pk], "inner").drop(pk)
            found |= {w: f"{ref}_s{w.column}" for w in wanted}
        return df, [found.get(o, o) if isinstance(o, LateRef) else o for o in outs]
