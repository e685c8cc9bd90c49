"""Physical helpers: shared scratch tables and distributed fixpoints."""
