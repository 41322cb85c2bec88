"""Part of treeloom: sources."""
