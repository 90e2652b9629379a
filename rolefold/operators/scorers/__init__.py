"""Evaluation: ranking, retrieval, extraction, stability, memory, calibration."""
