"""Text formats: writers, readers, the data source, and XML."""
