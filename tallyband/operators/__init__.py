"""Report operators on DataFrames. Where rows need an order it is given by columns that are unique together."""
