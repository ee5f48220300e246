"""Images derived from star-schema tables, and the registered queries on them."""
