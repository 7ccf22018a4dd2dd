"""Operators for large training corpora: one module per operator, `queries` and `oracles` register them."""
