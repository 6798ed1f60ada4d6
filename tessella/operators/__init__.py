"""DataFrame -> DataFrame operators, grouped by what they compute."""
