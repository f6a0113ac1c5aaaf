"""Training-data operators: ten Spark jobs over documents and pages."""
