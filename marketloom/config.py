"""Parameter sets. Defaults are fixed values carried over unchanged, but for those marked as ours."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

FEATURES = (
    "gap",
    "mom5",
    "mom10",
    "mom20",
    "gk_vol",
    "liquidity",
    "turnover_share",
    "imbalance",
    "bias",
    "broker_strength",
)

PRICE_FIELDS = ("O", "H", "L", "C")
PANEL_FIELDS = ("O", "H", "L", "C", "V", "VAL", "inside_vol", "outside_vol")


@dataclass(frozen=True)
class CleanConfig:
    adjust_by_adj_close: bool = True
    forward_fill: bool = True
    back_fill: bool = True
    auto_non_tradable: bool = True
    winsorize_p: float = 0.01
    bias_ma_n: int = 10
    bias_use_ema: bool = False
    bias_ema_half_life: float = 10.0
    broker_strength_ema: int = 3
    # Ours.
    adv_window: int = 30
    winsorize_by: str = "dt"


@dataclass(frozen=True)
class CostConfig:
    fee_buy: float = 0.001425
    fee_sell: float = 0.004425
    min_fee: float = 20.0
    gamma_impact: float = 4e-4
    beta_imb_impact: float = 0.0


@dataclass(frozen=True)
class RiskTarget:
    m: float = 1.0
    sigma_star: float = 0.01
    tau_max: float = 0.20
    turn_norm: str = "L1"

    def __post_init__(self):
        if self.turn_norm not in ("L1", "L2"):
            raise ValueError(f"turn_norm must be L1 or L2, got {self.turn_norm!r}")


@dataclass(frozen=True)
class RiskConfig:
    corr_half_life: float = 30.0
    sigma_source: str = "GK"
    std_window: int = 30
    c_liq: float = 0.6
    eps: float = 1e-8
    # Ours: symbols per covariance block: a task holds two blocks of window x block values.
    block_size: int = 256

    def __post_init__(self):
        if self.sigma_source not in ("GK", "STD"):
            raise ValueError(f"sigma_source must be GK or STD, got {self.sigma_source!r}")

    @property
    def horizon(self) -> int:
        """Days that enter the correlation: 60 half-lives. A day before them has a weight below 2 ** -60, less than
        the rounding of a sum of doubles."""
        return math.ceil(60 * self.corr_half_life)


@dataclass(frozen=True)
class StandardizeConfig:
    clip: float = 3.0
    fill_missing_with_zero: bool = True


@dataclass(frozen=True)
class TrainConfig:
    window: int = 252
    half_life: float = 60.0
    model: str = "RIDGE"
    lam: float = 1.0
    lasso_max_iter: int = 500
    lasso_tol: float = 1e-7

    def __post_init__(self):
        if self.model not in ("RIDGE", "LASSO"):
            raise ValueError(f"model must be RIDGE or LASSO, got {self.model!r}")


STAGE1 = TrainConfig(window=60, half_life=20.0)


@dataclass(frozen=True)
class CalibrationConfig:
    q50: float = 0.003
    q75: float = 0.010
    z_clip: float = 3.0


@dataclass(frozen=True)
class EnhanceConfig:
    theta_b: float = 0.10
    theta_imb: float = 0.10
    theta_ts: float = 0.10
    kappa_bias: float = 1.00
    theta_bias: float = 0.10


@dataclass(frozen=True)
class CapConfig:
    a_b: float = 0.0
    a_bias: float = 0.0
    theta_bias: float = 0.10
    kappa_adv: float = 0.0
    kappa_ts: float = 0.0


@dataclass(frozen=True)
class SweepConfig:
    sigma_star: tuple[float, ...] = (0.006, 0.008, 0.010, 0.012)
    tau: tuple[float, ...] = (0.10, 0.15, 0.20, 0.25)
    impact_scale: tuple[float, ...] = (0.7, 1.0, 1.3)
    dedup_l1_radius: float = 0.02
    k_keep: int = 30


@dataclass(frozen=True)
class PolicyConfig:
    alpha: float = 0.95
    top_k_by_mean: int = 0
    max_pairs: int = 0
    seed: int = 12345


@dataclass(frozen=True)
class ExecutionConfig:
    notional: float = 1.0
    lambda_risk: float = 0.0
    lambda_budget: float = 0.1
    odd_lots: bool = True
    risk_quick_scale: float = 0.9
    reduce_only: bool = False


@dataclass(frozen=True)
class Config:
    clean: CleanConfig = field(default_factory=CleanConfig)
    cost: CostConfig = field(default_factory=CostConfig)
    target: RiskTarget = field(default_factory=RiskTarget)
    risk: RiskConfig = field(default_factory=RiskConfig)
    standardize: StandardizeConfig = field(default_factory=StandardizeConfig)
    train: TrainConfig = field(default_factory=TrainConfig)
    calibrate: CalibrationConfig = field(default_factory=CalibrationConfig)
    enhance: EnhanceConfig = field(default_factory=EnhanceConfig)
    caps: CapConfig = field(default_factory=CapConfig)
    sweep: SweepConfig = field(default_factory=SweepConfig)
    policy: PolicyConfig = field(default_factory=PolicyConfig)
    execution: ExecutionConfig = field(default_factory=ExecutionConfig)
