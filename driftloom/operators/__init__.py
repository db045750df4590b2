"""Relational operators: baselines, detectors, windows, change-point tests, alerts."""
