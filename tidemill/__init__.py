"""tidemill: governed entity and campaign analytics on PySpark."""
