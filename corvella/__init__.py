"""Document and comment analytics as ordinary Spark DataFrame transformations."""
