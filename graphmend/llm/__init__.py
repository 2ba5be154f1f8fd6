"""Training-data pipeline operators; nothing else in the package imports this subpackage."""
