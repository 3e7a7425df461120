"""Named analytic queries composed from the operators."""
