"""clonelens: clone-pair analytics expressed as Spark plans."""
