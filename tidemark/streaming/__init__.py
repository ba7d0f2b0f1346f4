"""The transform as a streaming query."""
