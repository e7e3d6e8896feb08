"""Statistics that grow chunk by chunk."""
