"""DataFrame -> DataFrame operators; each takes frames and column names and stays lazy unless stated."""
