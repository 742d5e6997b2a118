"""Column functions: everything here is an expression Spark can run on its own."""
