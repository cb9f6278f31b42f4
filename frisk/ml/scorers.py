"""What a scorer is: a function that adds ``fraud_proba`` and ``anomaly`` to feature rows.

``fixed_scorer`` is a hand-set logistic curve.  It needs no training, so reports, sweeps and
policies can be checked against plain SQL; the trained scorer lives in ``frisk.ml.model``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[DataFrame], DataFrame]

INTERCEPT = -5.0
COEFFICIENTS = {
    "amount_log": 0.15, "new_device": 1.0, "new_merchant": 0.5, "new_country": 1.5, "new_beneficiary": 0.75,
    "high_risk_mcc": 0.5, "failed_logins_1h": 0.5, "entity_max_fraud_rate": 6.0, "ring_size": 0.125,
    "seq_surprise": 1.0,
}


def fixed_scorer(df: DataFrame) -> DataFrame:
    z = F.lit(INTERCEPT)
    for name, c in COEFFICIENTS.items():
        z = z + c * F.col(name)
    return df.withColumns({
        "fraud_proba": F.round(1.0 / (1.0 + F.exp(-z)), 6),
        "anomaly": F.round(1.0 - F.exp(-(F.col("txn_count_24h") + 4 * F.col("is_night")) / 8.0), 6),
    })
