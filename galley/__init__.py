"""Article extraction and enrichment as Spark jobs over tables of pages and texts."""
