"""Text-to-vector analytics on Spark: cleaning, prompts, budgets, splitting, embedding, calibration, caching, reranking."""
