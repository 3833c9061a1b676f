"""Plan helpers: intermediate tables and Arrow stages."""
