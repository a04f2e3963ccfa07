"""Jobs made of operators: reports by name, exports, refreshes, imports."""
