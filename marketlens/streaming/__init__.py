"""Event streams: parsing, keyed state, scoring."""
