"""Training-data operators over documents, conversations and embeddings."""
