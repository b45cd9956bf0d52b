"""Named datasets, reports, the query registry and its SQL oracle."""
