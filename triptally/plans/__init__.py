"""The indices and reports, composed from the operators."""
