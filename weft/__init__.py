"""A PySpark engine for typed knowledge graphs joined to text and vector indexes."""
