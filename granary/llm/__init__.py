"""Training-data operators: cleaning, scanning, formatting, packing, archiving, mixing and deduplication.

Nothing outside this package imports it, so it can be removed as a whole.
"""
