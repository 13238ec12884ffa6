"""Metric tables: latest values, windows, rules, alerts and reports."""
