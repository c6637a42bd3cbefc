"""Reading and writing corpora, run results, embeddings and fitted models."""
