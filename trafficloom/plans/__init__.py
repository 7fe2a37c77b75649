"""Jobs that write tables: store, retention, archive, export, reports."""
