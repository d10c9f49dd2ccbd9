"""DataFrame to DataFrame transforms that give the same answer on a table and on a stream."""
