"""millwright: production-planning and terrain analytics on PySpark."""
