"""Training-data operators: quality, packing, sketches, tokens, scoring, archives.

Nothing outside this package (and ``corpus_pipeline.py`` at the repository
top) imports it.  Every operator takes a DataFrame plus column names, selects
only the columns it needs under private names, and returns a fixed schema, so
extra or clashing input columns never reach it.
"""
