"""The analytics operators: each takes DataFrames and parameters and gives a DataFrame back."""
