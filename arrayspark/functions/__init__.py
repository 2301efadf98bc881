"""Element-wise functions: arithmetic as C and IEEE 754 have it, the expression language, user functions."""
