"""Training-data operators: jobs over documents, conversations or embeddings."""
