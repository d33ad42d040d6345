"""The same queries in SQL, and a runner that compares the rows."""
