"""Imports every catalogue module so that its queries register."""

from . import q_answers, q_ensemble, q_ireval, q_judged, q_metrics, q_prep, q_profile, q_results, q_retrieval, q_text, q_training, q_verdicts  # noqa: F401
