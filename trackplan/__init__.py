"""A PySpark engine for planning, checking and reconciling work over collections of records."""
