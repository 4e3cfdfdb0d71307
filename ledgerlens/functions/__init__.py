"""Column-expression functions (F1-F17) and the wide integer sum."""
