"""Part of treeloom: operators."""
