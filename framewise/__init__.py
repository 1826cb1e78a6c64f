"""Frame, event and map analytics for multi-cell recordings, expressed as Spark DataFrame programs."""
