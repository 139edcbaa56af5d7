"""Jobs composed from the operators, and their bindings to the driver tables."""
