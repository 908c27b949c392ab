"""Column-level functions; everything here stays a Spark expression or an Arrow UDF."""
