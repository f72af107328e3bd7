"""Run parameters. Operators never read a clock: ``as_of`` is always passed in."""

from __future__ import annotations

from dataclasses import dataclass, field

from storyrank import constants as K


@dataclass(frozen=True)
class Profile:
    """What one reader (or a default reader) wants; all driver-side constants."""

    alpha: float = K.RANKING["alpha"]
    beta: float = K.RANKING["beta"]
    gamma: float = K.RANKING["gamma"]
    family_weights: dict = field(default_factory=lambda: dict(K.FAMILY_AUTHORITY))
    tiers: dict = field(default_factory=lambda: dict(K.TIER_THRESHOLDS))
    mutes: tuple = ()
    subfields: tuple = ()
    venues: tuple = ()
    cluster_threshold: float = K.STORY_COSINE


def tier_thresholds(overrides: dict | None = None) -> dict:
    """Thresholds with defaults filled in; a non-numeric override keeps the default."""
    out = dict(K.TIER_THRESHOLDS)
    for key in out:
        value = (overrides or {}).get(key, out[key])
        try:
            out[key] = float(value)
        except (TypeError, ValueError):
            pass
    return out
