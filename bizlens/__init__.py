"""bizlens: growth analytics for many small businesses as PySpark DataFrame jobs."""
