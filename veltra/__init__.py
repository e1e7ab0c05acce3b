"""A compact analytics engine on PySpark: SQL dialect, versioned key-value tables, Arrow interchange."""
