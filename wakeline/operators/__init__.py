"""Relational operators over telemetry, voyages, the register and predictions."""
