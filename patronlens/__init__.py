"""Customer analytics and churn operators for Spark DataFrames."""
