"""Training-data operators: tokenising, extraction, scoring, de-duplication, packing, filtering and media columns.

Nothing outside this subpackage imports it. Every operator takes DataFrames, reads only the columns it names (extra
columns never clash: working columns are selected explicitly) and states in its docstring what nulls, empty texts,
ties and repeated rows give.
"""
