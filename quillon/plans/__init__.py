"""From SQL text of the dialect to Spark SQL text, and plans as text."""
