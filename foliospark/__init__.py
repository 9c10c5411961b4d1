"""Document and invoice analytics on Spark DataFrames."""
