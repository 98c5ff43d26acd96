"""Reading and writing of tables, mappings and documents."""
