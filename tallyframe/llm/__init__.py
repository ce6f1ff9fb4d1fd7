"""Training-data operators: cleaning, packing, near-duplicates, mixing, scoring, redaction, search and archive audits.

Nothing else in the package imports this subpackage; ``__spark_entry__`` adds its queries when it is present.
"""
