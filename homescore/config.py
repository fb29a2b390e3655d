"""Every threshold, weight and column list used by the scoring jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

# The key columns and thresholds that define the published KPIs.
DEVICE_KEYS = ("rowkey", "rk_row_sn", "serial_num", "station_mac")
DEVICE_PARENT_KEYS = DEVICE_KEYS + ("parent_id",)
HOME_KEYS = ("serial_num", "mdn", "cust_id")
DEVICE_GROUP_KEYS = HOME_KEYS + ("rowkey", "rk_row_sn", "station_mac")
TOPOLOGY_SETS = ("RouExt_mac", "dg_model", "parent_mac", "firmware", "parent_id", "Rou_Ext")

# The metrics of the device-feature table.
FEATURE_METRICS = (
    "sdcd_tx_link_rate",
    "sdcd_link_rate",
    "airtime",
    "bandwidth",
    "channel_freq",
    "trans_packets",
    "recv_packets",
    "snr",
    "sdcd_signal_strength",
    "byte_send",
    "byte_received",
    "diff_tx_packets",
    "diff_rx_packets",
)

# The features averaged over a window of days.
WINDOW_FEATURES = (
    "avg_phyrate",
    "poor_phyrate",
    "poor_rssi",
    "device_score",
    "weights",
    "stationarity",
    "volume",
    "avg_sig_strength_cat1",
    "avg_sig_strength_cat2",
    "avg_sig_strength_cat3",
)

# The features of the sweep and of the deployed model.
SWEEP_FEATURES = ("avg_phyrate", "poor_phyrate", "poor_rssi", "count")
MODEL_FEATURES = (
    "poor_phyrate",
    "poor_rssi",
    "avg_phyrate",
    "avg_sig_strength_cat1",
    "avg_sig_strength_cat2",
    "before_home_score",
    "count",
    "volume",
)

# Bins of the per-feature increment report and edges of the increment report.
FEATURE_BINS = {
    "avg_phyrate": (0, 200, 300, 400, 500, 2400),
    "poor_phyrate": (0, 2, 4, 6, 10, 20, 30, 100),
    "poor_rssi": (0, 10, 20, 30, 40, 50, 60, 70, 100),
    "count": (0, 100, 200, 300, 400, 500, 600, 700, 2000),
}
INCREMENT_EDGES = (-20, 0, 10, 20, 30, 50, 70)


@dataclass(frozen=True)
class KpiRules:
    """Thresholds of the per-device KPIs."""

    weak_signal: tuple[tuple[str, int], ...] = (("2.", -78), ("5G", -75), ("6G", -70))
    min_readings: int = 36
    rate_above: int = 6
    rate_below: int = 2500
    rate_excluded: tuple[int, ...] = (12, 24)
    slow_rate: int = 65
    percentiles: tuple[float, float, float, float] = (0.03, 0.1, 0.5, 0.9)
    spread_factor: int = 2
    stationary_spread: int = 5
    # True keeps a device only when a reading lies strictly above the outlier bound,
    # so a device whose readings are all equal is dropped.
    strict: bool = True

    @property
    def bands(self) -> tuple[str, ...]:
        return tuple(band for band, _ in self.weak_signal)


@dataclass(frozen=True)
class ScoreRules:
    """Mix of the two KPIs in a device score, and the rate under which a device counts for less."""

    rssi_share: float
    phy_share: float
    reference_rate: float = 20.718


SCORE_A = ScoreRules(0.4, 0.6)
SCORE_B = ScoreRules(0.4, 0.6)
SCORE_C = ScoreRules(0.5, 0.5)


@dataclass(frozen=True)
class ModelFamilies:
    """Router model names of a deployment.

    `main` models keep their name, `other` models are reported as one family and
    any model in neither list is dropped.
    """

    main: tuple[str, ...]
    other: tuple[str, ...] = ()
    other_label: str = "others"

    @property
    def routers(self) -> tuple[str, ...]:
        return self.main + self.other


@dataclass(frozen=True)
class ImprovementRule:
    """Rule classifier: homes expected to gain from an extender."""

    avg_phyrate_below: float = 400
    poor_phyrate_above: float = 6
    poor_rssi_above: float = 20
    count_above: int = 200


@dataclass(frozen=True)
class ForestParams:
    trees: int = 50
    depth: int = 5
    min_leaf: int = 5
    seed: int = 42


@dataclass(frozen=True)
class RecommendationRules:
    features: tuple[str, ...] = MODEL_FEATURES
    imputed: tuple[str, ...] = ("avg_sig_strength_cat1", "avg_sig_strength_cat2")
    required: tuple[str, ...] = ("before_home_score", "volume")
    signal_defaults: tuple[tuple[str, float], ...] = (
        ("avg_sig_strength_cat1", -60.0),
        ("avg_sig_strength_cat2", -65.0),
    )
    train_score_above: float = 50
    deploy_score_below: float = 100
    forest: ForestParams = field(default_factory=ForestParams)
