"""tessel: validation, scoring, curation and analytics of record collections as Spark jobs."""
