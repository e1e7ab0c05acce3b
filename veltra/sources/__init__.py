"""Sources and sinks: versioned tables, sorted key files, write-ahead and record logs, Arrow interchange."""
