"""Thresholds of the rules: tiers of named values, a default and a calibrated profile, partial overrides."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from types import SimpleNamespace

#: Names (the keys of override files) and defaults of each tier.
TIERS = {
    "verdict": {"forged_risk": 0.85, "forged_min_findings": 5, "suspicious_risk": 0.40, "suspicious_min_findings": 3, "urgency_critical": 0.85, "urgency_high": 0.40, "urgency_medium": 0.15},
    "enforcement": {"critical": 0.65, "high": 0.40, "medium": 0.20, "upload_critical": 0.50, "upload_high": 0.30, "upload_medium": 0.12, "ai_detector_override": 0.45},
    "fusion": {
        "cnn_dampening_floor": 0.30, "cnn_dampening_threshold": 0.35,
        "deep_mod_min": 0.55, "mesorch_min": 0.40, "ela_min": 0.50, "ela_scale": 0.80, "single_tamp_min": 0.50, "single_tamp_scale": 0.85,
        "text_ai_min": 0.50, "content_val_min": 0.40,
        "detector_high": 0.45, "detector_low": 0.15, "independent_confirm": 0.25,
        "boost_strong_min_high": 2, "boost_strong_floor": 0.75, "boost_moderate_min_high": 1, "boost_moderate_floor": 0.65, "swin_min": 0.60,
        "c2pa_factor": 0.50, "ai_metadata_floor": 0.90,
        "verdict_low_threshold": 0.15, "verdict_mid_threshold": 0.30, "verdict_high_threshold": 0.65,
        "risk_critical": 0.85, "risk_high": 0.40, "risk_medium": 0.20,
    },
    "base_risk": {"critical": 0.75, "high": 0.50, "medium": 0.25},
    "module_damage": {
        "ai_generation_detection": 0.50, "clip_ai_detection": 0.45, "prnu_detection": 0.45, "vae_reconstruction": 0.45, "spectral_forensics": 0.45, "deep_modification_detection": 0.50,
        "modification_detection": 0.45, "metadata_analysis": 0.45, "semantic_forensics": 0.50, "optical_forensics": 0.50, "text_ai_detection": 0.45, "content_validation": 0.40,
    },
}


class Profile:
    """Tiers as attributes, each with its thresholds as attributes; module_damage, whose names are open, is a mapping."""

    def __init__(self, tiers: Mapping[str, Mapping[str, float]] = TIERS):
        self._tiers = {tier: dict(values) for tier, values in tiers.items()}
        self.verdict, self.enforcement, self.fusion, self.base_risk = (SimpleNamespace(**self._tiers[t]) for t in ("verdict", "enforcement", "fusion", "base_risk"))
        self.module_damage = dict(self._tiers["module_damage"])

    def __eq__(self, other) -> bool:
        return isinstance(other, Profile) and self._tiers == other._tiers

    def overridden(self, values: Mapping[str, Mapping]) -> Profile:
        """A copy with what a parsed override file says. Tiers and keys that aren't known are warned about and skipped; modules may be new."""
        tiers = {tier: dict(held) for tier, held in self._tiers.items()}
        for tier, more in values.items():
            if tier.startswith("_"):
                continue
            if tier not in tiers:
                warnings.warn(f"unknown tier {tier}", stacklevel=2)
                continue
            for k, v in more.items():
                if tier == "module_damage":
                    tiers[tier][k] = float(v)
                elif k in tiers[tier]:
                    tiers[tier][k] = type(tiers[tier][k])(v)
                else:
                    warnings.warn(f"unknown threshold {tier}.{k}", stacklevel=2)
        return Profile(tiers)


DEFAULT = Profile()
#: The profile derived from production rows (derived_thresholds gives that of a table of one's own).
CALIBRATED = DEFAULT.overridden(
    {
        "fusion": {
            "cnn_dampening_threshold": 0.22, "cnn_dampening_floor": 0.30, "independent_confirm": 0.22, "detector_high": 0.50, "detector_low": 0.15,
            "risk_medium": 0.15, "risk_high": 0.34, "risk_critical": 0.85, "boost_strong_floor": 0.75, "boost_strong_min_high": 2, "boost_moderate_floor": 0.55, "boost_moderate_min_high": 1,
        }
    }
)

#: Weights of the core modules of the fused score.
CORE_WEIGHTS = {"dino": 0.20, "organika": 0.25, "community": 0.25, "clip": 0.20, "pixel": 0.10, "ai_generation": 0.0}

#: The modules whose risk alone makes a finding, in order: key in module_damage, cause, severity below and from .60.
FINDING_MODULES = {
    "ai_generation": ("ai_generation_detection", "AI generiranje", "Severe", "Critical"),
    "clip": ("clip_ai_detection", "AI generiranje", "Moderate", "Severe"),
    "vae": ("vae_reconstruction", "Sumnjiva tekstura", "Moderate", "Severe"),
    "deep_modification": ("deep_modification_detection", "Digitalna manipulacija", "Moderate", "Severe"),
    "modification": ("modification_detection", "Rekompresijski artefakti", "Moderate", "Moderate"),
    "text": ("text_ai_detection", "AI generiranje", "Moderate", "Severe"),
    "content": ("content_validation", "Krivotvoreni identifikatori", "Severe", "Critical"),
}
#: An upload's thresholds are this much lower, down to the second value; a module without a threshold has the third.
UPLOAD_OFFSET, LEAST_THRESHOLD, OTHER_THRESHOLD = 0.10, 0.10, 0.40
#: Causes that the enforcement treats as fraud.
FRAUD_CAUSES = ["AI generiranje", "Digitalna manipulacija", "Copy-paste krivotvorina", "Rekompresijski artefakti", "Deepfake indikator", "Sumnjiva tekstura", "Spektralna anomalija", "Statisticka anomalija"]


def finding_threshold(module: str, upload: bool, profile: Profile = DEFAULT) -> float:
    found = profile.module_damage.get(FINDING_MODULES[module][0], OTHER_THRESHOLD)
    return max(LEAST_THRESHOLD, round(found - UPLOAD_OFFSET, 6)) if upload else found
