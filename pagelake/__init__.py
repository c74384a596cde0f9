"""Analytics over tables of fetched web pages, on PySpark."""
