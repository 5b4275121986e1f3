"""Column expressions: physics, geometry, calendars, scores and text."""
