"""Events, projections, dead letters and idempotency."""
