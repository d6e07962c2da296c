"""Settings of a history job."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import fixed_values as V
from ..functions.periods import label_of, month_of, quarter_of


@dataclass(frozen=True)
class HistoryConfig:
    """Dates, home category and variants; inconsistent cut-offs are refused."""

    cutoff: str
    last_complete_quarter: str
    partial_quarter: str
    panel_start_quarter: str = "1950Q1"
    min_valid_start: str = "1950-01-01"
    home: str = "Home"
    end_rules: tuple = V.END_RULES
    primary_rule: str = V.CARRY_TO_CUTOFF
    primary_spec: str = V.FALLBACK_SPEC
    persistence: tuple = V.PERSISTENCE_QUARTERS
    windows: dict = field(default_factory=dict)  # name -> (start label, end label), first is primary
    taxonomy: dict = field(default_factory=lambda: V.TITLE_TAXONOMY)

    def __post_init__(self):
        if self.partial_q != self.cutoff_midx // 3 or self.last_q != self.partial_q - 1:
            raise ValueError("the partial quarter must contain the cutoff and follow the last complete quarter")
        unknown = set(self.end_rules) - set(V.END_RULES)
        if unknown:
            raise ValueError(f"unknown end rules {sorted(unknown)}")

    @property
    def cutoff_midx(self) -> int:
        return month_of(self.cutoff)

    @property
    def panel_start_q(self) -> int:
        return quarter_of(self.panel_start_quarter)

    @property
    def last_q(self) -> int:
        return quarter_of(self.last_complete_quarter)

    @property
    def partial_q(self) -> int:
        return quarter_of(self.partial_quarter)

    @property
    def window_quarters(self) -> dict[str, tuple[int, int]]:
        return {n: (quarter_of(a), quarter_of(b)) for n, (a, b) in self.windows.items()}

    def window_label(self, name: str) -> str:
        a, b = self.window_quarters[name]
        return f"{label_of(a)}-{label_of(b)}"
