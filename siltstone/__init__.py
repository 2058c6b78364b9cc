"""siltstone: quality control and evaluation of nested text datasets on PySpark."""
