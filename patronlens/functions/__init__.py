"""Column expressions and small relational building blocks shared by the operators."""
