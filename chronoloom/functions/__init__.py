"""Column functions over label sets and times."""
