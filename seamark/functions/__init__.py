"""Compilers from declarative specs to Spark columns."""
