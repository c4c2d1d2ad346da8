"""Tunable parameters. Defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MartOptions:
    """One mart flavour: weights, thresholds and how undefined values are treated."""

    tier_weights: tuple[tuple[int, float], ...]
    other_weight: float
    score_threshold: float
    zscore_threshold: float
    plain_means: bool           # mean(score*weight) instead of sum(score*weight)/sum(weight)
    zero_undefined: bool        # undefined z-score or index becomes 0.0 instead of NULL
    category_counts: bool
    volume_scale: float | None  # None: avg*ln(1+n); otherwise avg*(1+n/scale)
    min_tickers: int = 500
    min_days: int = 180
    min_daily_headlines: int = 500


# Fixed values of the two flavours.
WAREHOUSE = MartOptions(
    tier_weights=((1, 3.0), (2, 2.0)), other_weight=1.0,
    score_threshold=0.50, zscore_threshold=2.0,
    plain_means=False, zero_undefined=False, category_counts=False, volume_scale=None,
)
LOCAL = MartOptions(
    tier_weights=((1, 1.2), (2, 1.0), (3, 0.82)), other_weight=0.82,
    score_threshold=0.12, zscore_threshold=1.5,
    plain_means=True, zero_undefined=True, category_counts=True, volume_scale=20.0,
)


@dataclass(frozen=True)
class InsightOptions:
    positive_threshold: float = 0.12
    negative_threshold: float = -0.12
    horizon_days: int = 5
    lookback_hours: int = 72
    lookback_days: int = 3
    evidence_rows: int = 10


@dataclass(frozen=True)
class PortfolioOptions:
    starting_cash_cad: float = 5000.0
    max_positions: int = 5
    cash_reserve_pct: float = 0.05
    usd_to_cad_rate: float = 1.37
    positive_threshold: float = 0.12
    max_risk: float = 0.65
    min_order_cad: float = 25.0


@dataclass(frozen=True)
class HealthOptions:
    min_headlines: int = 50
    min_insights: int = 10
    max_synthetic_pct: float = 35.0
    stale_hours: float = 3.0
