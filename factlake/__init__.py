"""factlake: a PySpark-native analytics engine for versioned fact logs."""
