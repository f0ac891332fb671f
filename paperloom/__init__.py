"""Spark jobs for collections of working documents.

Change events become one normalised document table, documents are chunked and
pooled into vectors, routed to groups by similarity, and searched with cited
sources.  Every operator takes DataFrames and returns a DataFrame.
"""
