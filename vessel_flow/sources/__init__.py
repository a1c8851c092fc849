"""Sources: AIS CSV / zip scans, dimensions, fixture mapping."""
