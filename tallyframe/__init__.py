"""Registry snapshot analytics as Spark jobs: sources, functions, operators, data products and streams over repeated snapshots."""
