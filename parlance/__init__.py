"""A PySpark-native analytics engine for time-stamped, multi-speaker conversation transcripts."""
