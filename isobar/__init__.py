"""isobar: gridded time-series analytics as Spark plans."""
