"""Document analytics on Spark: page lines in, reviewed records out."""
