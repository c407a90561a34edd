"""Column functions; everything is a Spark expression unless its module says otherwise."""
