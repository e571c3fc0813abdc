"""Document-fleet analytics on Spark: files, pages, blocks, edits, forms, graphs and logs as tables."""
