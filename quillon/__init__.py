"""A PySpark engine for versioned clinical resources: extraction, search and analytics."""
