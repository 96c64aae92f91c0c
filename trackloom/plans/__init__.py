"""Whole runs: features of a section, training and prediction, with resume and reports."""
