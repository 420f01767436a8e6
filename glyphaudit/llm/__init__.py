"""Training-data operators: stand-alone operators over document and vector tables.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
