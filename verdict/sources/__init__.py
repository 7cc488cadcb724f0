"""Scans (S1-S13) and sinks (K1-K6): declared schemas, never inferSchema."""
