"""Catalog planning for large photo and file libraries, as Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame.  Nothing is sent
anywhere: the planned actions and the next state are the output.
"""
