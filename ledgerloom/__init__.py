"""Analytics over decision records and source code, on Spark."""
