"""Expression trees, search strategies, archives and runs, compiled to DataFrame plans."""
