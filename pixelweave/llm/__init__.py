"""Training-data operators. Nothing outside this subpackage imports it.

Rules that hold for every operator here:

* Input frames may carry any further columns; only the named id, text or vector columns are read, and every working
  column starts with ``_``, so names in the input cannot clash.
* A null text is an empty text. A null id is kept as null in the result.
* Tables that several jobs read are written once, as Parquet, to the folder in ``spark.checkpoint.dir``, so a lost
  executor costs a reread and never a different row order.
"""
