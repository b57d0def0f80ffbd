"""Column expressions: each function takes Columns and returns a Column."""
