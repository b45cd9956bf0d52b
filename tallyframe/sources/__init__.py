"""Base-table scans, code normalisation, the report sink and the register views."""
