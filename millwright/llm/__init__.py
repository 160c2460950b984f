"""Training-data operators over documents and pages. Nothing else in the package imports this."""
