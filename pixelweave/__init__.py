"""pixelweave: spatial risk analytics on pixel tables, as Spark DataFrame operators."""
