"""Expense audit and policy-document jobs on Spark DataFrames."""
