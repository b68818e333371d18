"""Part of tracewell; see the package docstring."""
