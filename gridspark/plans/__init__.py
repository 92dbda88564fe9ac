"""Planning: which arrays make a table, which chunks a filter leaves, and the SQL forms."""
