"""clonelens subpackage."""
