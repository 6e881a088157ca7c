"""Training-data pipeline operators (WARC, dedup, search, packing, mixing, scoring).

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
