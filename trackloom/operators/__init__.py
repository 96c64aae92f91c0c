"""Operators on keypoint tables, frame labels, probabilities and intervals."""
