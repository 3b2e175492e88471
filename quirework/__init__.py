"""Document analytics on Spark DataFrames: gazette text in, queryable tables out."""
