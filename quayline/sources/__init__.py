"""Table sources, sinks and the fixture adapter."""
