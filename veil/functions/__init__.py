"""Column expressions: nothing here moves data between tasks."""
