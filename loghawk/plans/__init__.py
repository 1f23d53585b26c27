"""Physical-strategy helpers and end-to-end plans built from the operators."""
