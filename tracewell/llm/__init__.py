"""Training-data operators over text, page and vector tables.

Every operator takes DataFrames and returns DataFrames; only the columns it
names are read, so extra columns, whatever they are called, are ignored by the
scoring functions and carried along unchanged by the filtering ones.
"""
