"""Column functions: plain arithmetic on built-ins, and the few special functions that Spark lacks."""
