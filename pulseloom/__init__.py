"""pulseloom: inter-pulse interval analytics expressed as Spark DataFrame plans."""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

#: Public names and where they are; a module is imported when its first name is used.
_PLACES = {
    "functions.dsp": ["synthesize", "denoise", "detect", "cfar", "intervals"],
    "operators.campaign": ["detection_curves", "detection_sensitivity", "phase_density", "slice_metrics", "spectral_metrics", "time_metrics"],
    "operators.decide": ["campaign_summary", "campaign_verdicts", "compare_baselines", "segment_verdicts"],
    "operators.detect": ["array_pulses", "delta_t_vector", "pulse_shapes", "threshold_peaks"],
    "operators.features": ["ablation", "descriptors", "roc"],
    "operators.hypothesis": ["adf", "bootstrap", "cohens_d", "kruskal", "ljung_box", "mann_whitney", "nis", "report"],
    "operators.intervals": ["delta_t", "fold_phase", "grid_frequency", "stitch"],
    "operators.studies": ["best_cell", "complexity", "convergence_study", "denoising_grid", "snr_study", "synthetic_signals"],
    "operators.track": ["adaptive_ewma", "compare", "cusum", "kalman", "lms", "log_ewma", "rls", "unified"],
    "pipeline": ["dataset_campaign", "descriptor_report", "empirical", "material", "material_run", "synthetic_run", "validate_files"],
    "sources.waveform_files": ["load", "load_config"],
}
_MODULES = {name: module for module, names in _PLACES.items() for name in names}
__all__ = ["__version__", *sorted(_MODULES)]


def __getattr__(name: str):
    if name not in _MODULES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_MODULES[name]}"), name)
