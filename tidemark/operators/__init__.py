"""Requests over DataFrames: one module for each data model."""
