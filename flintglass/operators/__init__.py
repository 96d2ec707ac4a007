"""Part of the inspection engine."""
