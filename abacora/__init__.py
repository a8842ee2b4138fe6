"""abacora: curation, answer scoring and evaluation of math-text corpora on Spark."""
