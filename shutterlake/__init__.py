"""Analytics for photo and video libraries on PySpark."""
