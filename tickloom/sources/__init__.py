"""Sources: frame tables, raw captures and connection attributes."""
