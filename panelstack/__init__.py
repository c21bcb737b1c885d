"""panelstack."""
