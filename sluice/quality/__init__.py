"""Data quality: rules, profiles, reports, duplicates."""
