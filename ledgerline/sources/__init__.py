"""Readers and sinks: raw frames, JSON documents, logs and canonical tables."""
