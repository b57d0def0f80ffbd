"""DataFrame operators: each takes DataFrames and returns a DataFrame or a small fitted model."""
