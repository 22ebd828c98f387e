"""Results handed out in batches."""
