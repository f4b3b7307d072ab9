"""Part of the feed engine."""
