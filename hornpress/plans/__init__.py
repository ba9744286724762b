"""Rules, their compilation to DataFrames, and the search for them."""
