"""Training-data operators: scans, classifiers, deduplication, search, media, mixing, packing.

Nothing else in the library imports this subpackage.  Operators read their
inputs lazily and return DataFrames; anything that must be read twice is written
to the folder all executors share (``spark.checkpoint.dir``).
"""
