"""Part of tempolith."""
