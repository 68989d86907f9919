"""The query catalogue: operators applied to the driver's tables."""
