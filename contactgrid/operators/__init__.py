"""DataFrame-in, DataFrame-out operators. None of them creates a session or collects rows."""
