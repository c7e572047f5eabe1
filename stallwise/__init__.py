"""Retail network analytics on Spark DataFrames.

Facts are sales orders, dimensions are sales points, sites and terminals. Every operator
is a function from DataFrames to a DataFrame; "now" is always the ``as_of`` argument.
"""
