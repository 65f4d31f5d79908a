"""Reading the raw tables and keeping the tables of each stage."""
