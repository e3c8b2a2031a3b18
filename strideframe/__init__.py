"""Movement analytics for video-derived tables, written as Spark DataFrame functions."""
