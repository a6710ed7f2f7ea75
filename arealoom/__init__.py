"""Area statistics, flows and maps as Spark jobs."""
