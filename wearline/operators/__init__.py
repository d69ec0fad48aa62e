"""DataFrame-to-DataFrame building blocks; most of them work on batches and on streams."""
