"""Training-data operators. Nothing outside this sub-package imports it."""
