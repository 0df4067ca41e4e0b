"""What stands for a string until it is fetched."""

from __future__ import annotations

from dataclasses import dataclass

from joinloom.plans.plan import TableInput


@dataclass(frozen=True)
class LateRef:
    """A string to be fetched: by the reference column ``ref``, column ``column`` of ``table``."""

    ref: str
    table: TableInput
    column: int
