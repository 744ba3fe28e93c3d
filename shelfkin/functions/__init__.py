"""Column expressions: cleaning, dates, numbers.  All of them are native Spark expressions."""
