"""Column expressions. All are stateless, so they also apply to streaming DataFrames."""
