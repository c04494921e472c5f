"""The gate's state kept by a stream of events."""
