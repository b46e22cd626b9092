"""A PySpark engine for episodic retrieval."""
