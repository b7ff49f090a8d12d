"""Content-based item similarity and recommendations as Spark jobs."""
