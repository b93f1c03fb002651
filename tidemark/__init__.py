"""Change feeds on Spark: incremental scans, snapshot diffs and ordered, at-least-once delivery as DataFrame plans."""
