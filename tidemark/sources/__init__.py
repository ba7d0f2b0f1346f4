"""Readers and writers: Kafka, replayed records, run artifacts."""
