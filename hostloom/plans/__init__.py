"""Jobs made of several operators, and the catalogue of registered queries."""
