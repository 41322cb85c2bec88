"""Part of treeloom: streaming."""
