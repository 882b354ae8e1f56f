"""tidemill: observation mapping, diagnostics and data preparation as Spark DataFrame jobs."""
