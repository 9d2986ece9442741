"""Reading flat tables, giving columns their types, and writing results."""
