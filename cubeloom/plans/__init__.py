"""Registered queries and how they bind to the driver's tables."""
