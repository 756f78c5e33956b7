"""Column functions, and the few Python ones."""
