"""Operators for texts: packing, mixing and quality. Nothing else in the library needs this subpackage."""
