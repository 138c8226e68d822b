"""Spark jobs over corpora of LaTeX papers and of training text."""
