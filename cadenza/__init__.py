"""Turn-taking and silence-span analytics as PySpark DataFrame operators."""
