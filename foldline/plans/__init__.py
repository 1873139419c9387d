"""Query plans and their catalogue."""
