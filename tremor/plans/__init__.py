"""The registered queries of the library."""
