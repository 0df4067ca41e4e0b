"""Join-plan engine on Spark DataFrames.

A plan is a tree of base-table scans and inner equi-joins, addressed by column
position over four types.  ``compile_plan`` turns it into one lazy DataFrame;
Catalyst and adaptive execution choose the physical strategy.
"""

from joinloom.plans.compile import compile_plan, execute
from joinloom.plans.plan import JoinNode, Plan, PlanNode, ScanNode, TableInput
from joinloom.types import DataType, PlanError, PlanTypeError

__all__ = [
    "DataType", "JoinNode", "Plan", "PlanError", "PlanNode", "PlanTypeError",
    "ScanNode", "TableInput", "compile_plan", "execute",
]
