"""Corpus curation, weak labelling, sampling, scoring and audit operators as Spark plans."""
