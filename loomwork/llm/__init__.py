"""Training-data operators: filtering, deduplication, decontamination and tokenisation at corpus scale."""
