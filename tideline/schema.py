"""Fixed schemas and the legal combinations of variable definitions."""

from __future__ import annotations

from dataclasses import dataclass, field

from tideline.functions.durations import Duration

OBSERVATION = (
    "indicator_id string, value double, anchor_time timestamp_ntz, support_kind string, summary_operator string, "
    "anchor_policy string, observation_window string, support_start timestamp_ntz, support_end timestamp_ntz"
)
DTYPES = ("continuous", "binary", "count", "ordinal", "categorical")
AGGREGATIONS = ("first", "last", "sum", "count", "mean", "std")
#: Which aggregations a measurement type allows.
LEGAL = {
    "ordinal": {"first", "last"},
    "categorical": {"first", "last"},
    "binary": {"first", "last"},
    "count": {"first", "last", "sum", "count"},
    "continuous": {"first", "last", "sum", "mean", "std"},
}
FILLS = ("forward", "backward", "min", "max", "mean", "zero", "one")


@dataclass(frozen=True)
class Variable:
    """What a variable measures and how it is computed from raw rows."""

    id: str
    dtype: str = "continuous"
    aggregation: str = "mean"
    window: str = "1d"
    column: str | None = None
    rule: str | None = None
    fill: str | float | None = None
    fill_limit: int | None = None
    levels: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.dtype not in DTYPES or self.aggregation not in LEGAL[self.dtype]:
            raise ValueError(f"{self.id}: {self.aggregation} of {self.dtype} isn't legal")
        coded = self.dtype in ("ordinal", "categorical")
        if coded != bool(self.levels) or (coded and (len(self.levels) < 2 or len(set(self.levels)) < len(self.levels))):
            raise ValueError(f"{self.id}: ordinal and categorical variables have two unique levels or more, others none")
        if isinstance(self.fill, str) and self.fill not in FILLS:
            raise ValueError(f"{self.id}: unknown fill {self.fill}")
        if self.fill_limit is not None and (self.fill not in ("forward", "backward") or self.fill_limit < 0):
            raise ValueError(f"{self.id}: only forward and backward fills have a limit")
        if Duration.parse(self.window).calendar and self.support_kind == "point":
            raise ValueError(f"{self.id}: calendar windows need an interval summary")

    @property
    def support_kind(self) -> str:
        return "point" if self.aggregation in ("first", "last") else "interval"

    @property
    def anchor_policy(self) -> str:
        return "support_start" if self.aggregation == "first" else "support_end"
