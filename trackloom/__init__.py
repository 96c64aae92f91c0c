"""Trajectory analytics on PySpark: from keypoint tables to behaviour intervals."""
