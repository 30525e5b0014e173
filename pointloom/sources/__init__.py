"""Sources and sinks: text and binary formats of point sets, tables, dumps."""
