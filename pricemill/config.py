"""Settings: a plain nested dictionary with dotted reading, deep merging and policy profiles."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

# The published defaults of the recommendation pipeline.
DEFAULTS: dict[str, Any] = {
    "data": {"week1_start_date": "1989-09-14", "min_price": 0.01, "min_qty": 1},
    "modeling": {"train_frac": 0.70, "valid_frac": 0.15, "lags": [1, 2, 3, 4], "rolling_windows": [4, 8, 13]},
    "eligibility": {"min_observations": 40, "min_distinct_prices": 5, "min_price_cv": 0.05},
    "optimization": {"objective": "gross_profit", "price_step": 0.05, "price_rounding": 0.01, "charm_pricing": False},
    "policy_profiles": {
        "conservative": {
            "max_price_change_pct": 0.05, "extrapolation_tolerance_pct": 0.02, "min_gross_margin_rate": 0.10, "materiality_threshold_pct": 0.02,
            "allow_below_cost": False, "high_risk_action": "keep_current", "medium_risk_max_price_change_pct": 0.03,
        },
        "standard": {
            "max_price_change_pct": 0.10, "extrapolation_tolerance_pct": 0.05, "min_gross_margin_rate": 0.05, "materiality_threshold_pct": 0.01,
            "allow_below_cost": False, "high_risk_action": "review_required", "medium_risk_max_price_change_pct": 0.05,
        },
        "aggressive": {
            "max_price_change_pct": 0.20, "extrapolation_tolerance_pct": 0.10, "min_gross_margin_rate": 0.0, "materiality_threshold_pct": 0.005,
            "allow_below_cost": False, "high_risk_action": "recommend", "medium_risk_max_price_change_pct": 0.20,
        },
    },
    "risk": {
        "low_risk": {"min_observations": 150, "min_distinct_prices": 15, "max_extrapolation_pct": 0.02},
        "medium_risk": {"min_observations": 80, "min_distinct_prices": 8, "max_extrapolation_pct": 0.05},
    },
    "pricing_response": {"method": "shrunk", "min_abs_elasticity": 0.2, "max_abs_elasticity": 6.0},
    "elasticity": {"min_obs_per_upc": 200, "min_distinct_prices_per_upc": 10, "max_se_for_product_estimate": 1.5},
    "monitoring": {
        "psi_bands": {"stable_below": 0.10, "moderate_below": 0.25},
        "alerts": {"psi_alert": 0.25, "wape_alert": 0.70, "bias_abs_alert": 10.0, "schema_check_is_hard_fail": True},
    },
}


class Config:
    """Reading of nested settings by dotted names."""

    def __init__(self, changes: dict[str, Any] | None = None):
        self.values = merged(DEFAULTS, changes or {})

    def __getitem__(self, dotted: str) -> Any:
        found: Any = self.values
        for part in dotted.split("."):
            if not isinstance(found, dict) or part not in found:
                raise KeyError(f"no setting {dotted}")
            found = found[part]
        return found

    def policy(self, profile: str) -> dict[str, Any]:
        profiles = self["policy_profiles"]
        if profile not in profiles:
            raise KeyError(f"no policy profile {profile}; there are {', '.join(sorted(profiles))}")
        return dict(profiles[profile])


def merged(base: dict[str, Any], changes: dict[str, Any]) -> dict[str, Any]:
    """base with changes laid over it, dictionaries entry by entry; neither is altered."""
    out = deepcopy(base)
    for key, value in changes.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else deepcopy(value)
    return out
