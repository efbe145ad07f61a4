"""End-to-end plans and registered queries."""
