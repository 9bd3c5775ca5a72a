"""paperloom: document-structure analytics as Spark DataFrame transformations."""
