"""Training-data operators: language ID, packing, token counts, URL filters, HTML
extraction, decontamination, licence scans, quality rules and two kinds of dedup.

Nothing else in the library imports this package.
"""
