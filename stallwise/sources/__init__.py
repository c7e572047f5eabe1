"""Reading and writing: the only modules that touch paths, formats and connectors."""
