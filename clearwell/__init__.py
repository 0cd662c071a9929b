"""clearwell: text sanitising, scanning and redaction as Spark DataFrame transforms."""
