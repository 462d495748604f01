"""corpusforge: Spark jobs for building, cleaning and judging augmented text corpora."""
