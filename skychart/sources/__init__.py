"""Reading and writing of the stage tables."""
