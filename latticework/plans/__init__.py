"""Multi-step plans: principal components and embeddings."""
