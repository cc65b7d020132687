"""The engine and the catalogue of registered queries."""
