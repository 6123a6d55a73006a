"""End-to-end model flows and the registered queries."""
