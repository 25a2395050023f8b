"""Choices between ways to answer a query, made on the driver from counts."""
