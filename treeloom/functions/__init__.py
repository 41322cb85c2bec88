"""Part of treeloom: functions."""
