"""Column functions over trajectories."""
