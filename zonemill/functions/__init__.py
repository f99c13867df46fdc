"""Column → Column functions. Everything here stays inside whole-stage codegen."""
