"""Ready-made plans: table views and end-to-end jobs built from the operators."""
