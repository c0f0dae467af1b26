"""Run parameters: cohort, observation window, as-of date and bank vocabulary."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CampaignNames:
    """Campaign groups that have a conversion rule, as they appear in the campaign list."""

    product_bundle: str = "Product Bundle"
    any_activity: str = "Any Activity"
    loan_decision: str = "Loan Decision"
    stash_opening: str = "Stash Opening"
    cross_sell: str = "Cross Sell"
    ignored: tuple[str, ...] = ("Win Back",)

    @property
    def with_rule(self) -> tuple[str, ...]:
        return (self.product_bundle, self.any_activity, self.loan_decision,
                self.stash_opening, self.cross_sell)


@dataclass(frozen=True)
class Params:
    """Everything a pipeline needs besides its tables; no feature ever reads the clock."""

    cohort_from: str = "1995-01-01"
    cohort_to: str = "1998-12-31"
    obs_from: str = "1995-01-01"
    obs_to: str = "2001-12-31"
    as_of: str = "2002-01-01"
    offsets: tuple[int, int] = (120, 150)
    bank: str = "Bank"
    main_account_prefix: str = "608"
    balance_rank: int = 90
    min_balance: int = 100
    campaigns: CampaignNames = field(default_factory=CampaignNames)

    @property
    def main_account(self) -> str:
        return f"{self.bank} Account"

    @property
    def inside(self) -> str:
        return f"Inside {self.bank}"

    @property
    def outside(self) -> str:
        return f"Outside {self.bank}"
