"""Research-document analytics on PySpark: composable DataFrame functions."""
