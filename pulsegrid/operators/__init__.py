"""DataFrame -> DataFrame operators of product analytics."""
