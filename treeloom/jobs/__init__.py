"""Part of treeloom: jobs."""
