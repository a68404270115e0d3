"""Part of the sluice engine."""
