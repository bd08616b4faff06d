"""End-to-end workflows and the query registry."""
