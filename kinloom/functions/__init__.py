"""Column functions: text normalisation, blocking-key encoders and similarity measures."""
