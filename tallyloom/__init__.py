"""Spark jobs over tables of order-form readings."""
