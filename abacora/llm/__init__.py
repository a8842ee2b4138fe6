"""Training-data operators; nothing outside this folder and corpus_pipeline.py imports it."""
