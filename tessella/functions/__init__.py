"""Column helpers: scalars, row frames and hot-group-safe ranking."""
