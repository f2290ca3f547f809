"""featspark: PySpark analytics over learned features of biological sequence models."""
