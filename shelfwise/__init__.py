"""Shelfwise: product-catalogue quality analytics on PySpark."""
