"""Point-in-time analytics over public disclosures, as plain Spark DataFrame jobs."""
