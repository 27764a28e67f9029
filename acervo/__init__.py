"""Document-metadata analytics on Spark: curation, text repair, extraction, splitting and evaluation as DataFrame operators."""
