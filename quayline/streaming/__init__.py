"""Structured Streaming forms of alerting, lifecycle, learning and risk scoring."""
