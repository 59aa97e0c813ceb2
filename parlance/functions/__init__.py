"""Column functions, tolerant parsers and model interfaces."""
