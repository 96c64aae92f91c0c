"""Reading and writing of videos, tracking, annotations and results."""
