"""Every threshold in one place.  All operators take a ``Settings`` (default below)."""

from __future__ import annotations

from dataclasses import dataclass, replace

US = 1_000_000  # microseconds per second; event time is handled as long micros


@dataclass(frozen=True)
class Settings:
    # -- fixed values ----------------------------------------------------------
    risk_block: float = 0.90
    risk_challenge: float = 0.55
    risk_review: float = 0.28
    w_supervised: float = 0.75
    w_anomaly: float = 0.25
    cost_fn: float = 1.0
    cost_fp: float = 0.04
    travel_kmh: float = 900.0
    travel_min_km: float = 200.0
    travel_max_gap_s: int = 3 * 3600
    max_gap_s: int = 30 * 86400
    card_testing_count_5m: int = 6
    card_testing_max_amount: float = 200.0
    velocity_count_1h: int = 12
    velocity_min_history: int = 20
    velocity_multiple: float = 1.5
    ato_failed_logins: int = 5
    high_risk_mcc: tuple = ("crypto", "gift_card", "wire_transfer")
    entity_block_rate: float = 0.22
    ring_size_challenge: int = 4
    amount_hard_limit: float = 1_000_000.0
    amount_high: float = 200_000.0
    amount_new_device: float = 50_000.0
    amount_first_time: float = 25_000.0
    prior_strength: float = 20.0
    prior_fraud: float = 0.003
    prior_count: float = 1.0
    half_life_days: float = 30.0
    label_delay_hours: float = 72.0
    prune_idle_days: float = 90.0
    psi_window: int = 2000
    psi_min_samples: int = 400
    psi_watch: float = 0.18
    psi_alert: float = 0.35
    psi_rebaseline_after: int = 2500
    psi_rebaseline_window: int = 800
    psi_floor: float = 0.005
    psi_range_hi: float = 0.5
    psi_bins: int = 10
    ewma_keep: float = 0.9
    maturity_days: float = 45.0
    fraud_weight: float = 3.0
    isotonic_min_positives: int = 50
    feedback_cap: float = 0.15
    feedback_min_labels: int = 5
    case_buffer: int = 500
    model_threshold: float | None = None  # operator override of the learned cut-off
    # -- how the work is split -------------------------------------------------
    hot_rows: int = 1_000_000  # a key with more rows than this is cut into time chunks
    entity_groups: int = 512  # groups by hash in which a stream keeps the entities of one kind; fixed for a checkpoint
    customer_groups: int = 1024  # groups by hash in which a stream keeps its customers' profiles; fixed for a checkpoint
    prior_bucket_s: int = 600  # width of the buckets the global prior is summed over
    score_buckets: int = 256  # cut points used when a whole table is ranked by score

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)


DEFAULT = Settings()

# fixed values: decision labels, age brackets, policies
ACTIONS = ("ALLOW", "REVIEW", "CHALLENGE", "BLOCK")
STOPPED = ("BLOCK", "CHALLENGE")
ADVERSARIAL = ("amount_just_under", "slow_drip", "geo_consistent_ato")
AGE_BRACKETS = (("18-25", 18, 25), ("26-40", 26, 40), ("41-60", 41, 60), ("60+", 61, 100))
AGE_WEIGHTS = (0.14, 0.40, 0.32, 0.14)
OLDEST_DRAWN_AGE = 90
POLICIES = ("rules_only", "model_only", "full")

# fixed values: the 48 model columns, in order
BEHAVIOUR_COLUMNS = (
    "amount", "amount_log", "amount_z", "amount_to_max",
    "hour", "is_night", "is_weekend",
    "new_merchant", "new_country", "new_device", "new_beneficiary", "is_foreign",
    "dist_from_last_km", "speed_kmh", "impossible_travel", "secs_since_last",
    "txn_count_5m", "txn_count_1h", "txn_count_24h",
    "amt_sum_1h", "amt_sum_24h",
    "distinct_merchants_24h", "distinct_countries_24h",
    "failed_logins_1h", "logins_1h",
    "account_age_days", "high_risk_mcc",
    "channel_pos", "channel_online", "channel_atm", "channel_transfer",
)
SEQUENCE_COLUMNS = ("seq_surprise", "seq_new_token", "seq_repeat_5", "seq_regime_kl")
ENTITY_COLUMNS = (
    "merchant_fraud_rate", "merchant_txn_count", "merchant_age_days",
    "bin_fraud_rate",
    "device_fraud_rate", "device_customer_fanout", "device_is_global_new",
    "beneficiary_fraud_rate", "beneficiary_customer_fanin",
    "beneficiary_is_global_new", "beneficiary_txn_count",
    "entity_max_fraud_rate", "ring_size",
)
PROFILE_COLUMNS = BEHAVIOUR_COLUMNS + SEQUENCE_COLUMNS
FEATURE_COLUMNS = PROFILE_COLUMNS + ENTITY_COLUMNS
BASELINE_COLUMNS = ("peak_5m", "peak_1h", "history_n")
