"""Whole analyses, from the input table to the final report, put together from the operators."""
