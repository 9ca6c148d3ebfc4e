"""strataforge: versioned columnar snapshots and set-at-a-time index queries on Spark."""
