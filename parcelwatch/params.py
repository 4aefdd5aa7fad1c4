"""Business parameters. The defaults are the published thresholds and labels."""

from __future__ import annotations

from dataclasses import asdict, dataclass

# Words that mark a complaint about waiting, in Portuguese and English.
DELAY_KEYWORDS = (
    "atraso",
    "atrasado",
    "demorou",
    "demora",
    "tardou",
    "tarde",
    "delayed",
    "late",
    "slow",
    "waiting",
    "waited",
    "never arrived",
)

# Labels of the review scores.
SCORE_LABELS = {
    1: "Sangat Buruk",
    2: "Buruk",
    3: "Cukup",
    4: "Baik",
    5: "Sangat Baik",
}


# The parameters that act when tables are computed; all others act in the reports.
TABLE_FIELDS = (
    "impute_missing",
    "delivered",
    "complaint_max_score",
    "delay_keywords",
    "whole_words",
)


@dataclass(frozen=True)
class Params:
    # null policy: True replaces missing values before they are averaged
    impute_missing: bool = True

    # statuses
    delivered: str = "delivered"
    moving: tuple[str, ...] = ("delivered", "shipped")

    # reviews
    complaint_max_score: int = 2
    delay_keywords: tuple[str, ...] = DELAY_KEYWORDS
    whole_words: bool = False

    # routes
    hub_state: str = "SP"

    # stage statistics
    quantiles: tuple[float, float] = (0.50, 0.90)
    p90_limit_days: float = 5

    # seller service levels: upper bounds of Fast, Normal, Slow
    sla_days: tuple[float, float, float] = (1, 3, 7)
    # seller volume: lower bounds of High, Medium
    volume_orders: tuple[int, int] = (500, 100)
    # freight loss: lower bounds of large, medium
    loss_amounts: tuple[float, float] = (5000, 1000)
    # intervention: (days, late %) above which to act at once, or to monitor
    act_above: tuple[float, float] = (7, 30)
    monitor_above: tuple[float, float] = (3, 20)

    # qualification of sellers
    min_orders: int = 50
    min_orders_sla: int = 10
    slow_days: float = 2
    late_pct: float = 20
    target_days: float = 2

    # list lengths
    top_contributors: int = 50
    top_losses: int = 20

    # gap to the national average: False averages the group averages
    weighted_gap: bool = False

    def of_tables(self) -> dict:
        """The parameters the curated tables depend on, as plain values."""
        found = asdict(self)
        return {
            name: list(found[name]) if isinstance(found[name], tuple) else found[name]
            for name in TABLE_FIELDS
        }

    @classmethod
    def from_tables(cls, values: dict) -> Params:
        plain = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
        return cls(**plain)
