"""Operators that change or look up data: DML on versioned tables, and the versioned key-value log."""
