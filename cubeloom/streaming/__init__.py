"""Incremental forms of mergeable operators."""
