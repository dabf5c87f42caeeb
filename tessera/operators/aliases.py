"""Domain names for general operators; the names stay in the tree and its id."""

from __future__ import annotations

from .registry import get_spec, register_operator

#: The vocabulary and what each name means.
ALIASES = {
    "funding_z": "ts_zscore",
    "oi_change": "ts_pct_change",
    "fear_greed": "ts_mean",
    "btc_dominance_change": "ts_pct_change",
    "stablecoin_mcap_change": "ts_pct_change",
    "active_addresses_change": "ts_pct_change",
    "hashrate_change": "ts_pct_change",
    "dxy_change": "ts_pct_change",
    "spy_correlation": "ts_corr",
}

for _name, _target in ALIASES.items():
    _spec = get_spec(_target)
    register_operator(_name, arg_types=_spec.arg_types, causal_safe=_spec.causal_safe)(_spec.lower)
