"""paperloom: analytics over archives of legacy word-processor documents, as Spark jobs."""
