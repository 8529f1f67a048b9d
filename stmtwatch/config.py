"""Score weights and the small integer codes stored in the tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class RiskWeights:
    """Points per signal and the two score thresholds.

    A signal whose weight is zero or negative is switched off, which also drops its reason line.
    """

    block_level: int = 30
    warn_level: int = 20
    comments: int = 30
    sensitive: int = 10
    multiple: int = 30
    or_token: int = 5
    union: int = 10
    tautology: int = 30
    empty_password: int = 30
    bruteforce: int = 15

    @classmethod
    def from_mapping(cls, values: Mapping[str, object]) -> RiskWeights:
        """Override some of the defaults, e.g. from a settings row; unknown keys are an error."""
        known = {f.name for f in fields(cls)}
        unknown = set(values) - known
        if unknown:
            raise ValueError(f"unknown weight keys: {sorted(unknown)}")
        return replace(cls(), **{k: int(v) for k, v in values.items()})


# Policy modes.
MODE_RISK_BLOCK = 0
MODE_PRIVILEGE_BLOCK = 1
MODE_RISK_SIMULATION = 2
MODE_PRIVILEGE_SIMULATION = 3
MODE_ALWAYS_BLOCK_NEW = 4
MODE_LEARNING = 10
MODE_LEARNING_3DAYS = 11
MODE_LEARNING_7DAYS = 12
LEARNING_MODES = (MODE_LEARNING, MODE_LEARNING_3DAYS, MODE_LEARNING_7DAYS)

# Alert levels.
LEVEL_WARN = 0
LEVEL_BLOCKED = 1
LEVEL_HIGH_RISK = 2
LEVEL_LOW = 3

# Permission bits of a policy.
PERM_BITS = {"create": 1, "drop": 2, "alter": 4, "info": 8, "block": 16, "bruteforce": 32}

# Fixed value: an endpoint with this status is disabled.
ENDPOINT_DISABLED = 3
