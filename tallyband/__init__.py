"""Report-style data work on Spark: sources, functions, breaks, variables, followers, sections."""
