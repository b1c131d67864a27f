"""Physical layouts and plan descriptions."""
