"""Plan model: nodes addressed by index, columns addressed by position."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from joinloom.types import DataType, PlanError, PlanTypeError

#: One output column: position in the node's source columns, declared type.
Attr = tuple[int, DataType]


@dataclass(frozen=True)
class ScanNode:
    """Reads the input table with this ordinal; its source columns are the table's."""

    base_table_id: int


@dataclass(frozen=True)
class JoinNode:
    """Inner equi-join of two nodes; its source columns are left's outputs, then right's.
    ``spread``: keys have many rows on both sides, so their pairs are dealt over many tasks."""

    build_left: bool
    left: int
    right: int
    left_attr: int
    right_attr: int
    spread: bool = False


@dataclass(frozen=True)
class PlanNode:
    data: ScanNode | JoinNode
    output_attrs: tuple[Attr, ...]


@dataclass(frozen=True)
class TableInput:
    """A base table.  ``primary_key``: position of a unique, non-null column, which
    late materialisation may use as row reference; None if there is none."""

    df: DataFrame
    primary_key: int | None = None


@dataclass
class Plan:
    nodes: list[PlanNode] = field(default_factory=list)
    inputs: list[TableInput] = field(default_factory=list)
    root: int = 0

    def add_scan(self, table: int, attrs) -> int:
        self.nodes.append(PlanNode(ScanNode(table), tuple(attrs)))
        return len(self.nodes) - 1

    def add_join(self, left: int, right: int, left_attr: int, right_attr: int, attrs, build_left: bool = False, spread: bool = False) -> int:
        self.nodes.append(PlanNode(JoinNode(build_left, left, right, left_attr, right_attr, spread), tuple(attrs)))
        return len(self.nodes) - 1

    def types(self, idx: int) -> list[DataType]:
        return [t for _, t in self.nodes[idx].output_attrs]

    def validate(self) -> None:
        """Raises PlanError (indices, cycles) or PlanTypeError (types)."""
        if not self.nodes:
            raise PlanError("the plan has no nodes")
        for idx in self.order():
            self._check(idx)

    def order(self) -> list[int]:
        """The nodes under the root, each once, children first; raises on cycles."""
        self._check_index(self.root, "root")
        out, state, stack = [], {}, [self.root]
        while stack:
            idx = stack[-1]
            if state.get(idx) == "done":
                stack.pop()
                continue
            if state.get(idx) == "open":
                state[idx] = "done"
                out.append(stack.pop())
                continue
            state[idx] = "open"
            data = self.nodes[idx].data
            for child in () if isinstance(data, ScanNode) else (data.right, data.left):
                self._check_index(child, f"child of node {idx}")
                if state.get(child) == "open":
                    raise PlanError(f"node {child} is its own ancestor")
                stack.append(child)
        return out

    def _check_index(self, idx: int, what: str) -> None:
        if not 0 <= idx < len(self.nodes):
            raise PlanError(f"{what}: node {idx} is not one of {len(self.nodes)} nodes")

    def _check(self, idx: int) -> None:
        node = self.nodes[idx]
        if isinstance(node.data, ScanNode):
            source = self._scan_types(idx, node.data)
        else:
            join = node.data
            left, right = self.types(join.left), self.types(join.right)
            for attr, types, side in ((join.left_attr, left, "left"), (join.right_attr, right, "right")):
                if not 0 <= attr < len(types):
                    raise PlanError(f"node {idx}: {side} key {attr} is outside {len(types)} columns")
            if left[join.left_attr] is not right[join.right_attr]:
                raise PlanTypeError(f"node {idx}: key types {left[join.left_attr].name} and {right[join.right_attr].name} differ")
            source = left + right
        for pos, (attr, declared) in enumerate(node.output_attrs):
            if not 0 <= attr < len(source):
                raise PlanError(f"node {idx}: output {pos} takes column {attr} of {len(source)}")
            if source[attr] is not declared:
                raise PlanTypeError(f"node {idx}: output {pos} is declared {declared.name}, its source is {getattr(source[attr], 'name', 'outside the model')}")

    def _scan_types(self, idx: int, scan: ScanNode) -> list[DataType | None]:
        if not 0 <= scan.base_table_id < len(self.inputs):
            raise PlanError(f"node {idx}: table {scan.base_table_id} is not one of {len(self.inputs)} inputs")
        return [DataType.of(f.dataType) for f in self.inputs[scan.base_table_id].df.schema.fields]

    def to_json(self) -> str:
        """The nodes and the root; inputs are bound again on reading."""
        out = []
        for node in self.nodes:
            d = node.data
            body = {"scan": d.base_table_id} if isinstance(d, ScanNode) else {"join": [d.left, d.right, d.left_attr, d.right_attr], "build_left": d.build_left, "spread": d.spread}
            out.append(body | {"out": [[i, t.value] for i, t in node.output_attrs]})
        return json.dumps({"root": self.root, "nodes": out})

    @classmethod
    def from_json(cls, text: str, inputs: list[TableInput]) -> "Plan":
        raw = json.loads(text)
        plan = cls(inputs=list(inputs), root=raw["root"])
        for n in raw["nodes"]:
            attrs = [(i, DataType(t)) for i, t in n["out"]]
            if "scan" in n:
                plan.add_scan(n["scan"], attrs)
            else:
                left, right, lk, rk = n["join"]
                plan.add_join(left, right, lk, rk, attrs, n["build_left"], n.get("spread", False))
        return plan
