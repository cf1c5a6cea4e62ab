"""Issues, weights, contracts and settings of the procurement pair (vendor, transaction)."""

from __future__ import annotations

from dataclasses import dataclass

# Severities and their ranks.
SEVERITY_RANKS = {"low": 1, "medium": 2, "high": 3, "critical": 4}


@dataclass(frozen=True)
class Issue:
    name: str
    table: str
    severity: str

    @property
    def rank(self) -> int:
        return SEVERITY_RANKS[self.severity]


# The nine issues with table, severity and default weight.
ISSUES = {
    issue.name: issue
    for issue in (
        Issue("missing_vendor_name", "vendor", "high"),
        Issue("invalid_vendor_uei", "vendor", "critical"),
        Issue("invalid_domestic_state", "vendor", "high"),
        Issue("duplicate_vendor_id", "vendor", "critical"),
        Issue("orphan_vendor_reference", "transaction", "critical"),
        Issue("duplicate_transaction_key", "transaction", "critical"),
        Issue("invalid_performance_date_order", "transaction", "high"),
        Issue("negative_offer_count", "transaction", "medium"),
        Issue("action_date_outside_fiscal_year", "transaction", "high"),
    )
}
WEIGHTS = {
    "missing_vendor_name": 75,
    "invalid_vendor_uei": 100,
    "invalid_domestic_state": 75,
    "duplicate_vendor_id": 100,
    "orphan_vendor_reference": 100,
    "duplicate_transaction_key": 100,
    "invalid_performance_date_order": 75,
    "negative_offer_count": 50,
    "action_date_outside_fiscal_year": 75,
}
# Two-letter codes of states, districts, territories and free association.
STATE_CODES = (
    "AK", "AL", "AR", "AS", "AZ", "CA", "CO", "CT", "DC", "DE", "FL", "FM",
    "GA", "GU", "HI", "IA", "ID", "IL", "IN", "KS", "KY", "LA", "MA", "MD",
    "ME", "MH", "MI", "MN", "MO", "MP", "MS", "MT", "NC", "ND", "NE", "NH",
    "NJ", "NM", "NV", "NY", "OH", "OK", "OR", "PA", "PR", "PW", "RI", "SC",
    "SD", "TN", "TX", "UT", "VA", "VI", "VT", "WA", "WI", "WV", "WY",
)

# Controlled-defect plan and model settings.
DEFECT_SEED = 20240622
DEFECTS_PER_TYPE = 40
MODEL_SEED = 42
TOP_K = 50
REVIEW_FRACTIONS = {"vendor": 0.025, "transaction": 0.005}
TREES = 200
NEIGHBOURS = 35
MINIMUM_FEEDBACK = 24
MINIMUM_PER_CLASS = 8
VALIDATION_FRACTION = 0.3
VERDICTS = ("correct_flag", "false_alarm", "wrong_issue_type", "missed_issue", "unsure")
POSITIVE_VERDICTS = ("correct_flag",)
NEGATIVE_VERDICTS = ("false_alarm", "wrong_issue_type")


def check_weights(weights: dict[str, int], issues: dict[str, Issue] | None = None) -> None:
    """Weights must cover the issues exactly and lie in 0..100."""
    expected, given = set(issues or ISSUES), set(weights)
    if expected != given:
        raise ValueError(
            "Scoring weights must match canonical issues; "
            f"missing={sorted(expected - given)}, unexpected={sorted(given - expected)}"
        )
    if any(not 0 <= weight <= 100 for weight in weights.values()):
        raise ValueError("Scoring weights must be between 0 and 100")
