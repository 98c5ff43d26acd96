"""Training-data operators: mixing, scanning, deduplication, tokenization and archives.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
column names, keeps no state between calls and writes intermediate tables only to
the folder named by ``spark.checkpoint.dir`` (see ``shared.py``).
"""
