"""Query catalogue: each key binds operators to the supplied tables and
carries the equivalent SQL used as the correctness oracle."""
