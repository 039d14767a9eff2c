"""quillspark: text analytics as Spark DataFrame operators."""
