"""Analytics over evidence corpora on Spark: search, graphs, rankings, records, text, vectors, pipelines."""
