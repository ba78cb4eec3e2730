"""Structured Streaming: answer events, ingestion, telemetry."""
